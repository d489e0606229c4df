"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallyforge import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if pd.isna(v):
        return None
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return str(round(float(v), 6) + 0.0)
    return str(v).removesuffix(" 00:00:00")


def rows(frame):
    return sorted([tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
