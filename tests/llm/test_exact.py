import hashlib
import re

from pyspark.sql import functions as F

from kinfolio.llm import exact

SCHEMA = "doc_id long, text string, h string, row string, content string"
ROWS = [
    (5, "a b", "x", "1", "c"), (3, "a \t\n b", "x", "1", "c"), (9, "a b ", "x", "1", "c"), (8, None, None, None, None), (2, "", "x", "1", "c"), (4, " ", "x", "1", "c"), (6, "\r\n\x0b\x0c", "x", "1", "c"),
    (7, "a b", "x", "1", "c"), (7, "a b", "y", "2", "d"), (None, "a b", "x", "1", "c"), (None, "only null", "x", "1", "c"), (None, "only null", "x", "1", "c"),
    (1 << 60, "w " * 300_000, "x", "1", "c"), ((1 << 60) + 1, "w  " * 300_000, "x", "1", "c"),
]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for k, t in enumerate(norm):
        groups.setdefault(t, []).append(k)
    out = []
    for t, members in groups.items():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        low = min(ids, default=None)
        first = next(k for k in members if rows[k][0] == low)
        out += [(rows[k][0], low, len(members), k == first, hashlib.sha256(t.encode()).hexdigest()) for k in members]
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    found = exact.mark(spark.createDataFrame(ROWS, SCHEMA))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(ROWS)


def test_collisions_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for hashed in (lambda c: F.unhex(F.lit("00")), lambda c: F.unhex(F.substring(F.md5(c), 1, 1))):
        assert sorted(map(tuple, exact.mark(docs, hashed).collect()), key=str) == brute(ROWS)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_HASHES", 0)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, exact.mark(docs).collect()), key=str) == brute(ROWS)


def test_keep_returns_one_whole_row_a_content(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = exact.keep(docs)
    assert found.columns == docs.columns
    kept = [tuple(r) for r in found.collect()]
    assert sorted(str(r[0]) for r in kept) == sorted(str(r[0]) for r in brute(ROWS) if r[3])
    assert [r for r in kept if r[0] == 7] == [(7, "a b", "x", "1", "c")]
    assert (3, "a \t\n b", "x", "1", "c") in kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.mark(docs).collect() == [] and exact.keep(docs).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = exact.mark(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
