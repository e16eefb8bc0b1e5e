"""Every registered query runs; those with SQL agree with it."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 4) + 0.0
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    spark.catalog.clearCache()
    mine, theirs = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(duck.execute(ORACLES[name]).fetchdf())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    spark.catalog.clearCache()
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["province", "n_cells", "n_positive"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
