import random

from kinfolio.llm import packing

SCHEMA = "doc_id long, text string, place string"


def plain_opening(length, waiting, capacities):
    """What each capacity would cost per word if the rest of a bin were filled with the largest waiting piece that fits, again and again."""
    best = None
    for c in capacities:
        if c < length:
            continue
        used, left = length, sorted(waiting, reverse=True)
        while True:
            fits = [x for x in left if x <= c - used]
            if not fits:
                break
            left.remove(fits[0])
            used += fits[0]
        price = (min(k for k in capacities if k >= used) + packing.OVERHEAD) / used
        if best is None or price <= best[0]:
            best = (price, c)
    return best[1]


def plain(lengths, capacities):
    """The same rule without the structures: every open bin is looked at for every piece, every capacity is filled by search."""
    bins, where, places = [], [], []
    for k, x in enumerate(lengths):
        fits = [b for b in bins if b["room"] >= x]
        if fits:
            room = min(b["room"] for b in fits)
            # of equal rooms, the bin that came to it last
            chosen = max((b for b in fits if b["room"] == room), key=lambda b: b["stamp"])
        else:
            chosen = {"n": len(bins), "room": plain_opening(x, lengths[k + 1 :], capacities), "used": 0}
            bins.append(chosen)
        where.append(chosen["n"])
        places.append(chosen["used"])
        chosen["used"], chosen["room"], chosen["stamp"] = chosen["used"] + x, chosen["room"] - x, k + 1
    return where, places, [min(c for c in capacities if c >= b["used"]) for b in bins]


def test_best_fit_equals_plain_version():
    rng = random.Random(3)
    for trial in range(60):
        capacities = tuple(sorted(rng.sample(range(5, 60), 3)))
        lengths = sorted((rng.randint(1, capacities[-1]) for _ in range(rng.randint(0, 60))), reverse=True)
        assert packing.best_fit(lengths, capacities) == plain(lengths, capacities), trial


def test_rows_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOT", 7)
    out = packing.pack(spark.createDataFrame([(None, "a b c", "")] * 40 + [(1, "a b", "")] * 9, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.copy) for r in out) == [(False, k) for k in range(9)] + [(True, k) for k in range(40)]
    assert sum(r.length for r in out) == 138


def test_opening_prefers_the_cheaper_bin():
    waiting = packing.Counts()
    assert packing.opening(500, waiting, (512, 1024)) in (512, 1024)
    bins, _, sizes = packing.best_fit([500, 500, 20], (512, 1024))
    assert sizes == [1024] and bins == [0, 0, 0]
    assert packing.best_fit([600, 10], (512, 1024))[2] == [1024]
    assert packing.best_fit([300], (512, 1024, 4096))[2] == [512]


def test_all_words_are_placed_once(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 30, 700, 9000, 20001])), "") for k in range(120)]
    rows += [(500, None, ""), (501, "", ""), (1, "two words", ""), (1, "two words", ""), (None, "lost words here", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = packing.pack(df, pieces_a_shard=60).collect()
    want, got = {}, {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: n for i, n in want.items() if n}
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    assert len({r.bin_id.split("-")[0] for r in out}) > 1
    for b in bins.values():
        used = sum(r.length for r in b)
        at = 0
        for r in sorted(b, key=lambda r: r.place):
            assert r.place == at
            at += r.length
        assert {r.used for r in b} == {used}
        assert b[0].capacity == next(c for c in packing.CAPACITIES if c >= used)
    pieces = [(r.doc_id, r.copy, r.start) for r in out]
    assert len(pieces) == len(set(pieces))
    assert packing.pack(df.limit(0)).count() == 0
