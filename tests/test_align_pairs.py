"""Every session is aligned with the next one by number."""

import os

import duckdb
import pytest

from loomtrace.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_all_adjacent_pairs(spark):
    ids = {r[0] for r in duckdb.sql(f"SELECT DISTINCT user_id FROM '{FOLDER}/events.parquet'").fetchall()}
    got = sorted(r["pair_id"] for r in QUERIES["align_sessions"](spark, FOLDER).select("pair_id").collect())
    assert got == sorted(f"{i}:{i + 1}" for i in ids if i + 1 in ids) and any(int(p.split(":")[0]) % 2 for p in got)
