"""Similarity search with an inverted-file index: every vector lies in the list of its nearest centroid, a query looks into some lists.

Centroids are fitted on a bounded sample of the table, and so is the number of lists that a query looks
into: the least that finds FOUND of the sample's own neighbours. Every row of the table is indexed. Lists
are cut into chunks, so that one with a third of all rows is many tasks; no pair of a query and a vector
is made but within a chunk. corpus.nearest_of_each() is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.operators.storage import stored

#: Rows that centroids are fitted on (those of the least hashes of their ids), and those of them that act as queries.
SAMPLE, ASKED = 16_384, 512
#: Most lists. About the rows of a sample that make a list.
LISTS, PER_LIST = 256, 32
ROUNDS = 8
#: Share of the sample's neighbours that the lists looked into must hold.
FOUND = 0.97
#: Most vectors, and most queries, of a task's chunk, about.
CHUNK = 4_096

VECTOR = "id long, embedding array<float>"


@dataclass(frozen=True)
class Lists:
    """Centroids (a row each) for vectors of their length, and how many of the nearest lists a query looks into."""

    centroids: np.ndarray
    probes: int

    def order(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n best lists of each vector, best first."""
        near = vectors @ self.centroids.T
        return np.argsort(-near, axis=1, kind="stable")[:, :n]


def fit(vectors: DataFrame, top: int = 30, least: float = 0.25, found: float = FOUND) -> Lists:
    """Lists fitted on a sample of vectors (id, embedding); vectors of the sample's most common length count."""
    rows = vectors.filter("embedding is not null and size(embedding) > 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toPandas()
    lengths = rows["embedding"].map(len)
    if not len(rows):
        return Lists(np.zeros((0, 0)), 0)
    own = np.nan_to_num(np.stack(rows["embedding"][lengths == lengths.mode()[0]].to_list()).astype(float))
    n = int(np.clip(len(own) // PER_LIST, 1, LISTS))
    centroids = own[np.linspace(0, len(own) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        of = (own @ centroids.T).argmax(axis=1)
        for k in range(n):
            members = own[of == k]
            if len(members):
                mean = members.mean(axis=0)
                centroids[k] = mean / max(np.linalg.norm(mean), 1e-12)
    lists = Lists(centroids, n)
    of, asked = lists.order(own, 1)[:, 0], own[:ASKED]
    scores = asked @ own.T
    near = np.argsort(-scores, axis=1)[:, :top]
    kept = np.take_along_axis(scores, near, axis=1) >= least
    place = np.argsort(lists.order(asked, n), axis=1)  # of each list in a query's order
    needed = np.sort(np.take_along_axis(place, of[near], axis=1)[kept]) + 1
    return Lists(centroids, int(needed[int(np.ceil(len(needed) * found)) - 1]) if len(needed) else 1)


def _listed(lists: Lists, n: int):
    """Rows with the numbers of their n best lists; vectors of another length have a list by their length, below 0."""
    length = lists.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            own = [i for i, v in enumerate(given) if v and len(v) == length]
            at: list[list[int]] = [[-len(v)] if v else [] for v in given]
            if own:
                for i, best in zip(own, lists.order(np.nan_to_num(np.array([given[i] for i in own], float)), n).tolist(), strict=True):
                    at[i] = best
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32()))], ["id", "embedding", "lists"])

    return run


def index(vectors: DataFrame, lists: Lists) -> DataFrame:
    """id, embedding, list of every row (id, embedding) but null and empty vectors, which are like nothing; a stored table."""
    listed = vectors.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(_listed(lists, 1), f"{VECTOR}, lists array<int>")
    return stored(listed.select("id", "embedding", F.explode("lists").alias("list")), "vectors")


def _best(query_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, held: np.ndarray, top: int, least: float) -> Iterator[tuple[int, int, float]]:
    """query_id, id, score of the best rows for each query; ties by id."""
    known = np.nan_to_num(asked @ held.T, nan=-np.inf)
    for k, about in enumerate(known):
        bar = max(least, np.partition(about, len(about) - top)[len(about) - top]) if len(about) > top else least
        near = np.flatnonzero(about >= bar - 1e-9)
        exact = np.cumsum(held[near] * asked[k], axis=1)[:, -1]  # in order, so that equal vectors tie
        for i in np.lexsort((ids[near], -exact))[:top]:
            if exact[i] >= least:
                yield int(query_ids[k]), int(ids[near[i]]), float(exact[i])


def _search(top: int, least: float):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(rows) and len(queries):
            held = np.stack(rows["embedding"].to_list()).astype(float)
            for at in range(0, len(queries), 512):
                part = queries.iloc[at : at + 512]
                asked = np.stack(part["embedding"].to_list()).astype(float)
                out += _best(part["id"].to_numpy(), asked, rows["id"].to_numpy(), held, top, least)
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    return run


def search(indexed: DataFrame, queries: DataFrame, lists: Lists, top: int = 30, least: float = 0.25) -> DataFrame:
    """query_id, id, score: the best rows of index() for each query (id, embedding) with a score of least or more, ties by id.

    A query's neighbours outside the lists it looks into are missed. least must be above 0, the score
    of vectors of different lengths.
    """
    if least <= 0:
        raise ValueError("an index finds neighbours with scores above 0; nearest_of_each() finds others")
    probed = queries.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
    probed = probed.mapInArrow(_listed(lists, lists.probes), f"{VECTOR}, lists array<int>")
    asked = stored(probed.select("id", "embedding", F.explode("lists").alias("list")), "asked")
    # chunks of rows and of queries by list: a row per list
    parts = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))
    shape = stored(parts(indexed, "n_rows").join(parts(asked, "n_queries"), "list"), "shape")
    dealt = lambda df, own, other, a, b: (
        df.join(F.broadcast(shape), "list")
        .withColumn(a, F.pmod(F.xxhash64("id", F.lit(7)), F.col(own)).cast("int"))
        .withColumn(b, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .select("list", "r", "q", "id", "embedding")
    )
    rows, asking = dealt(indexed, "n_rows", "n_queries", "r", "q"), dealt(asked, "n_queries", "n_rows", "q", "r")
    keys = ("list", "r", "q")
    found = rows.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(_search(top, least), "query_id long, id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= top).drop("place")
