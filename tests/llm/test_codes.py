import hashlib
import math
import random

import pytest

from kinfolio.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, whole string"


def brute(rows, parts, entries, rounds, scale=256):
    """{(vec_id, embedding): (code, error)} and the codebooks' digest, in plain Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(x * scale) for x in r[1]] for r in kept]
    d = len(whole[0]) // parts
    cut = [[w[p * d : (p + 1) * d] for p in range(parts)] for w in whole]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            best = []
            for p in range(parts):
                far = [sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)) for e in books[p]]
                best.append((far.index(min(far)), min(far)))
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][0] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return [(r[0], r[2], "".join(f"{k:02x}" for k, _ in f), sum(x for _, x in f)) for r, f in zip(kept, assign(), strict=True)], digest


def vectors(n, width, seed=1):
    rng = random.Random(seed)
    import struct

    near = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    return [(k if k % 11 else None, [near(rng.gauss(k % 5 - 2, 1)) for _ in range(width)], k % 3 if k % 7 else None, "x", "y", "z") for k in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 37)
    monkeypatch.setattr(codes, "ROWS_AT_ONCE", 10)
    rows = vectors(400, 12)
    rows += [rows[5], rows[5], (2000, None, 1, "x", "y", "z"), (2001, [None] * 12, 1, "x", "y", "z"), (2002, [float("nan")] + [0.0] * 11, 1, "x", "y", "z"), (2003, [float("-inf")] + [0.0] * 11, 1, "x", "y", "z")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = codes.with_label_error(codes.compress(docs, parts=4, entries=8)).collect()
    want, digest = brute(rows, 4, 8, 2)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in found), key=str) == sorted(want, key=str)
    assert {r.codebooks_sha256 for r in found} == {digest}
    total = {}
    for w in want:
        total[w[1]] = total.get(w[1], 0) + w[3]
    assert {(r.label, r.label_error) for r in found} == set(total.items())


def test_fewer_vectors_than_entries_code_themselves(spark):
    rows = vectors(5, 16)
    found = codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.error for r in found} == {0} and len(found) == 5


def test_lengths_apart_and_padded(spark):
    a, b, c = vectors(60, 8), vectors(50, 7, 2), [(1, [], 0, "x", "y", "z")]
    found = codes.compress(spark.createDataFrame(a + c, SCHEMA), parts=4, entries=8).collect()
    want, digest = brute(a, 4, 8, 2)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in found if r.codebooks_sha256 == digest), key=str) == sorted(want, key=str)
    assert [(r.code, r.error) for r in found if r.codebooks_sha256 != digest] == [("00" * 4, 0)]
    found = codes.compress(spark.createDataFrame(b, SCHEMA), parts=4, entries=8).collect()
    want, digest = brute([(r[0], [*r[1], 0.0], *r[2:]) for r in b], 4, 8, 2)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in found), key=str) == sorted(want, key=str)


def test_too_large_a_component_is_an_error(spark):
    rows = [(1, [0.0] * 15 + [3e6], 0, "x", "y", "z")]
    with pytest.raises(Exception, match="magnitude"):
        codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()


def test_empty_table(spark):
    found = codes.with_label_error(codes.compress(spark.createDataFrame([], SCHEMA)))
    assert found.collect() == []
    assert {"vec_id", "label", "code", "error", "codebooks_sha256", "label_error"} == set(found.columns)
