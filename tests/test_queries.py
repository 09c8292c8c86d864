"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loomtrace.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    missing = lambda v: v is None or pd.api.types.is_scalar(v) and pd.isna(v)
    plain = lambda v: None if missing(v) else round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(con.execute(ORACLE_SQL[name]).fetchdf())


def test_every_query_but_two_has_sql():
    # held against the whole table of lengths in test_scale.py, and against brute force in test_nearest.py
    assert set(QUERIES) - set(ORACLE_SQL) == {"align_sessions", "nearest_vectors_indexed"}
