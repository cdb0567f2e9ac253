"""Queries against their SQL on the small tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from newsloom.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def rows(frame):
    def shown(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool) or not hasattr(v, "__float__"):
            return str(v)
        return f"{float(v):.6g}"

    return sorted(tuple(shown(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, D).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - {"full_run"}))  # which test_run runs
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, D).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
