import random

import numpy as np
import pytest

from kinfolio.llm import neardup
from kinfolio.operators.components import components

DOCS = "doc_id long, text string, component_id string"


def brute(rows, width, percent):
    import re

    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return sorted(str((i, len(x), root(i) if i is not None else None, i is None or root(i) == i)) for i, x in sets)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{k}é" for k in range(400)]
    rows = []
    for k in range(n):
        t = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        rows.append((10 * k, " ".join(t)))
        for c in range(rng.choice([0, 0, 1, 3])):
            u = list(t)
            for _ in range(rng.randint(0, 5)):
                u[rng.randrange(len(u))] = rng.choice(vocab)
            rows.append((10 * k + 1 + c, " ".join(u).upper() if c % 2 else "\n".join(u)))
    # a large group, chained: each text differs a little from the one before
    t = [rng.choice(vocab) for _ in range(90)]
    for k in range(60):
        t[rng.randrange(90)] = rng.choice(vocab)
        rows.append((5000 - k, " ".join(t)))
    rows += [(6000 + k, " ".join(t)) for k in range(40)]
    rows += [(7000, None), (7001, ""), (7002, " \t"), (7003, "one"), (7004, "ONE"), (7005, "one two"), (7006, "two one"), (None, " ".join(t)), (7003, "one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "similarity"), [(3, 0.85), (5, 0.8)])
def test_components_equal_brute_force(spark, width, similarity):
    rows = corpus(width)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], DOCS)
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in neardup.link(df, width=width, similarity=similarity).collect())
    assert got == brute(rows, width, round(100 * similarity))


def test_repeated_ids_hang_together(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(1, a, ""), (2, a, ""), (2, b, ""), (3, b, "")], DOCS)
    assert {r.component_id for r in neardup.link(df).collect()} == {1}


def test_empty(spark):
    assert neardup.link(spark.createDataFrame([], DOCS)).count() == 0
    assert neardup.link(spark.createDataFrame([(1, None, "")], DOCS)).collect()[0].kept


def test_odd_sketch_follows_similarity():
    rng = np.random.default_rng(0)
    x, f = neardup.parameters(neardup.bands_for(0.85) * neardup.ROWS)
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    bits = []
    for share in (1.0, 0.95, 0.7, 0.3, 0.0):
        drawn = []
        for _ in range(20):  # one draw strays by about ten bits, as much as the least similar pairs lie apart
            other = np.concatenate([base[: int(1000 * share)], rng.integers(0, 1 << 63, 1000 - int(1000 * share)).astype(np.uint64)])
            a, b = (neardup.odd_sketch(neardup.minhash(np.unique(h), x, f)) for h in (base, other))
            drawn.append(sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)))
        bits.append(drawn)
    means = [np.mean(d) for d in bits]
    assert means[0] == 0 and means == sorted(means)
    assert max(bits[1]) <= neardup.most_bits(0.85, len(x)) < min(bits[4])


def test_minhash_blocks_agree(monkeypatch):
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    x, f = neardup.parameters(160)
    whole = neardup.minhash(h, x, f)
    monkeypatch.setattr(neardup, "BLOCK", 1000)
    assert (neardup.minhash(h, x, f) == whole).all()


def test_stars(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 200)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(300)]
    up = {v: v for e in edges for v in e}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    loops = {a for a, b in edges if a == b}
    assert all(got[v] == root(v) for v in up if v in got) and set(up) - set(got) <= loops


def test_texts_of_one_id_and_equal_length_keep_their_near_copies(spark):
    rows = []
    for k in range(6):
        a, b = ([f"{x}{k}w{j}" for j in range(60)] for x in "ab")
        rows += [(10 * k, " ".join(a), ""), (10 * k, " ".join(b), ""), (10 * k + 1, " ".join([*a[:59], "end"]), ""), (10 * k + 2, " ".join([*b[:59], "end"]), "")]
    got = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i // 10 * 10 for i, *_ in rows}


def cut(n, seed):
    """One text of 400 words, and others that lack four stretches of 19 words each: just not near it. Some come in near pairs."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(400)]
    rows = [(0, " ".join(words))]
    for k in range(1, n):
        starts = sorted(rng.sample(range(400 - 4 * 19), 4))
        gone = {a + 19 * i + j for i, a in enumerate(starts) for j in range(19)}
        left = [w for j, w in enumerate(words) if j not in gone]
        rows.append((k, " ".join(left)))
        if k % 10 == 0:
            rows.append((10_000 + k, " ".join([*left[:-2], f"x{k}", "y"])))
    return rows


def test_texts_cut_from_one_make_few_pairs(spark, monkeypatch):
    counts = []
    sketched, lots = neardup.sketched, neardup.links_in_lots
    monkeypatch.setattr(neardup, "sketched", lambda pairs, *a: (counts.append(pairs.count()), sketched(pairs, *a))[1])
    monkeypatch.setattr(neardup, "links_in_lots", lambda *a: (links := lots(*a), counts.append(links.count()))[0])
    for n in (100, 200):
        counts.clear()
        rows = cut(n, 3)
        df = spark.createDataFrame([(i, t, "c") for i, t in rows], DOCS)
        got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in neardup.link(df).collect())
        assert got == brute(rows, 3, 85)
        # hubs: one of the first bands and three of each band a class; behind them, where all pairs could meet, few a class
        assert counts[0] <= neardup.FIRST_BANDS * len(rows) and counts[1] <= 3 * neardup.bands_for(0.85) * len(rows)
        assert len(counts) == 4 and sum(counts[2:]) <= len(rows)


def test_links_in_lots(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(neardup, "LOT", 16)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    pivot, rows, sets = list(range(300)), [], {}
    for k in range(120):
        have = sorted(rng.sample(pivot, rng.choice([200, 230, 260]))) if k % 3 else sorted(set(sets[k - 1][0]) - set(rng.sample(pivot, 20)) if k else pivot[:250])
        rest = sorted(rng.sample(range(1000, 1400), 12)) if k % 2 else [2000 + k % 5, 2010]
        sets[k] = (have, rest)
        bits = np.zeros(300, bool)
        bits[have] = True
        rows.append((k // 60, k, 0, k // 4 * 4, k % 4 != 0, len(have) + len(rest), rest, bytearray(np.packbits(bits).tobytes())))
    df = spark.createDataFrame(rows, "g long, rep long, which long, comp long, outside boolean, size long, rest array<long>, have binary")

    def joined(links):
        up = {k: k // 4 * 4 for k in range(120)}
        for a, b in links:
            p, q = up[a], up[b]
            up = {k: min(p, q) if v in (p, q) else v for k, v in up.items()}
        return up

    whole = {k: {("p", v) for v in h} | set(r) for k, (h, r) in sets.items()}
    near = {(a, b) for a in range(120) for b in range(a + 1, 120) if a // 60 == b // 60 and a // 4 != b // 4 and (a % 4 or b % 4) and 100 * len(whole[a] & whole[b]) >= 80 * len(whole[a] | whole[b])}
    got = {(r.a, r.b) for r in neardup.links_in_lots(df, 80).collect()}
    assert got <= near and near and joined(got) == joined(near)
    assert neardup.links_in_lots(df.limit(0), 80).count() == 0
