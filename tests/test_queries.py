"""Every registered query against its SQL twin on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["classification", "incidents", "errors", "avg_duration_ms"] and df.count() > 0
