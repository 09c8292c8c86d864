"""Searches with many queries."""

import os

import duckdb
import numpy as np
import pytest

from loomtrace.operators import corpus, vector_index
from loomtrace.plans.catalog import ORACLE_SQL, QUERIES
from tests.test_queries import rows

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "id long, embedding array<float>"


def test_each_query_has_its_neighbours(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK", 7)
    monkeypatch.setattr(corpus, "DEALT", 20)
    r = np.random.default_rng(2)
    vectors = [[float(x) for x in v] for v in r.normal(size=(60, 8))] + [[1.0] * 8] * 20 + [None, [1.0], []]
    table = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
    wanted = [i for i in range(80) if i % 10 == 0]
    got = {(r["query_id"], r["id"]): r["score"] for r in corpus.nearest_of_each(table, table.filter("id % 10 = 0 and id < 80"), top=5).collect()}
    assert got == {
        (i, n["id"]): n["score"] for i in wanted for n in corpus.nearest(table, [float(np.float32(x)) for x in vectors[i]], top=5).collect()
    }
    assert [n for i, n in sorted(got) if i == 60] == [60, 61, 62, 63, 64]


def test_no_rows_and_no_query(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("nearest_vectors_all", "nearest_vectors_indexed"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["nearest_vectors_all"])
def test_searches_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    got = rows(QUERIES[name](spark, FOLDER).toPandas())
    assert got and got == rows(con.execute(ORACLE_SQL[name]).fetchdf())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_index(spark, sf):
    """Of the exact neighbours at 30 the index finds 0.9 or more, and nothing else."""
    folder = f"/root/testdata/{sf}"
    exact = {(r.query_id, r.id): r.score for r in QUERIES["nearest_vectors_all"](spark, folder).collect()}
    got = {(r.query_id, r.id): r.score for r in QUERIES["nearest_vectors_indexed"](spark, folder).collect()}
    assert len(exact.keys() & got.keys()) >= 0.9 * len(exact) and all(got[k] == exact[k] for k in exact.keys() & got.keys())
    assert all(score >= 0.25 for score in got.values()) and max(sum(q == i for q, _ in got) for i, _ in got) <= 30


def _clusters(n, seed=1):
    """Vectors about 40 centres; a third of all lie about one."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, 16))
    rows = centres[np.where(r.random(n) < 0.33, 0, r.integers(0, 40, n))] + 0.3 * r.normal(size=(n, 16))
    return (rows / np.linalg.norm(rows, axis=1)[:, None]).tolist()


def test_clustered_vectors_need_few_lists_and_a_hot_list_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "CHUNK", 100)
    vectors = [*_clusters(1500), None, [], [1.0], [1.0], [float("nan")] * 16]
    table = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
    lists = vector_index.fit(table)
    assert lists.probes <= len(lists.centroids) / 3
    indexed = vector_index.index(table, lists)
    assert indexed.count() == len(vectors) - 2
    queries = table.filter("id % 50 = 0 or id >= 1500")
    exact = {(r.query_id, r.id) for r in corpus.nearest_of_each(table, queries).collect()}
    got = {(r.query_id, r.id) for r in vector_index.search(indexed, queries, lists).collect()}
    assert len(exact & got) >= 0.9 * len(exact) and {(1502, 1502), (1502, 1503), (1503, 1502), (1503, 1503)} <= got
    every = vector_index.search(indexed, queries, vector_index.Lists(lists.centroids, len(lists.centroids)))
    assert {(r.query_id, r.id) for r in every.collect()} == exact  # looking into all lists misses nothing
    with pytest.raises(ValueError):
        vector_index.search(indexed, queries, lists, least=0.0)


def test_no_cross_join(spark):
    table = spark.createDataFrame(list(enumerate(_clusters(200))), SCHEMA)
    lists = vector_index.fit(table)
    plan = vector_index.search(vector_index.index(table, lists), table, lists)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
