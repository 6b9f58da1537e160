"""Every query against its SQL at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from vigil.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def shown(v) -> str:
    if pd.isna(v):
        return "-"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(shown(v) for v in r) for r in df[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(found) == rows(sql.sql(ORACLES[name]).df())
    else:
        assert len(found)
