"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from almanac import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def cell(x):
        if isinstance(x, pd.Timestamp):
            return str(x.date()) if x == x.normalize() else str(x)
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        name = f.removesuffix(".parquet")
        con.sql(f"create view {name} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = plans.QUERIES[name](spark, DATA).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
