"""Every query with SQL: Spark and DuckDB must agree on the small tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from kelpwood import catalogue

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if type(v).__name__ in ("bool", "bool_", "str"):
        return str(v)
    try:
        return None if pd.isna(v) else round(float(v), 5) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(([plain(v) for v in r] for r in df.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = catalogue.queries()[name](spark, FOLDER).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0
