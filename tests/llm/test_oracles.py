"""Queries of the training-data operators against DuckDB SQL on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tapewright.llm import queries


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(queries.ORACLES[name]).df()
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    number = lambda df: df.astype({c: "float64" for c in df.columns if df[c].dtype.kind in "iuf" or str(df[c].dtype).startswith("Int")})
    assert plain(number(got)) == plain(number(want))
