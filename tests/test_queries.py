"""Every query of the library against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from loomspark.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(df):
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, con, name):
    got = catalog.queries()[name](spark, data).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got.columns)
        return
    want = con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
