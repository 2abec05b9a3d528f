import pytest

from kinfolio.llm import mixing

SCHEMA = "doc_id long, text string, source string, extra int"


def words(n):
    return " ".join(["w"] * n)


def brute_targets(sizes, weights, epochs=3):
    """Clamp and reshare until none is above: sizes and weights by source."""
    total, clamped, level = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(epochs * sizes[s] for s in clamped)
        free = sum(weights[s] for s in sizes if s not in clamped)
        level = {s: epochs * sizes[s] if s in clamped else rest * weights[s] / free for s in sizes}
        over = {s for s in sizes if s not in clamped and level[s] > epochs * sizes[s]}
        if not over:
            return level
        clamped |= over


def test_targets_and_taken(spark):
    rows = [(k, words(1 + k % 40), f"s{k % 5}" if k % 5 else None, 0) for k in range(500)] + [(1000 + k, words(3), "tiny", 0) for k in range(3)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(x for x in sizes if x is not None) + [None]
    target = brute_targets(sizes, {s: 1 + k % 3 for k, s in enumerate(order)})
    taken = {}
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6
        assert r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(out) == len(rows)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_corners(spark):
    rows = [(1, None, "a", 0), (2, "", "a", 0), (None, "x y", None, 0), (3, "x y z", "b", 0), (3, "x y z", "b", 0), (4, "q q \x0b r", "b", 0)]
    out = {(r.doc_id, r.size): r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[(1, 0)].taken == 0 and out[(2, 0)].target == 0.0
    assert out[(4, 2)].size == 2
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows, SCHEMA), max_epochs=0)


def test_repeated_rows_follow_the_plan(spark):
    rows = [(k, f"a{k} " + words(k % 7), f"s{k % 3}", k) for k in range(60)] + [(100, None, "s0", 0), (None, "n n", "s1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").split())
    for k in range(60):
        assert got.get(k, 0) == plan[k]
    assert 100 in got and None in got


def test_level_needs_rounds(spark):
    rows = spark.createDataFrame([("a", 1, 9), ("b", 10, 9), ("c", 1000, 1)], "source string, source_size long, weight long")
    level = mixing.water_level(rows, 1011, 3)
    assert abs(3 + 30 + level - 1011) < 1e-9
