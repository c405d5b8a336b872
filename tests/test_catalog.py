"""Every query against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tapewright.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fi":
            df[c] = df[c].astype(float).round(5) + 0.0
        else:
            df[c] = df[c].map(lambda v: float(v) if v.__class__.__name__ == "Decimal" else v)
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
