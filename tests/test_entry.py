"""The entry module's queries against their SQL on the smallest tables, if those are there."""

import os

import pytest

import __spark_entry__ as entry
from kinfolio.plans import catalogue

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 5) + 0.0)
    return str(value).removesuffix(" 00:00:00")


def test_sql_covers_the_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


@here
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@here
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted(tuple(canonical(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(canonical(r[n]) for n in names) for r in found.collect())
    assert got == want
