"""Operators over many sessions: filters, buckets, distributions, orderings, comparisons, similarity, notes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.operators.storage import numbered, stored


def matches(model: str | None = None, tool: str | None = None, errored: bool = False, annotated: bool = False) -> Column:
    """A condition on session rows: all given ones hold."""
    parts = [F.lit(True)]
    if model is not None:
        parts.append(F.array_contains("models", model))
    if tool is not None:
        parts.append(F.exists("tool_stats", lambda t: F.lower(t["name"]) == tool.lower()))
    if errored:
        parts.append(F.exists("tool_stats", lambda t: t["error_count"] > 0))
    if annotated:
        parts.append(F.col("annotation_count") > 0)
    return reduce(lambda a, b: a & b, parts)


def order_of(mode: str) -> list[Column]:
    """The order of sessions by mtime, cost, errors, tokens or format; ties by session_id."""
    keys = {
        "mtime": F.desc_nulls_last("mtime_secs"),
        "cost": F.coalesce(F.col("cost_usd"), F.lit(0.0)).desc(),
        "errors": F.desc("error_count"),
        "tokens": (F.col("tokens_in") + F.col("tokens_out")).desc(),
        "format": F.asc("format"),
    }
    return [keys[mode], F.col("session_id").asc()]


def ordered(sessions: DataFrame, mode: str) -> DataFrame:
    return sessions.orderBy(*order_of(mode))


def placed(sessions: DataFrame, mode: str) -> DataFrame:
    """sessions with their place (from 1) in an order, numbered by range partitions."""
    return numbered(sessions, *order_of(mode)).withColumn("place", (F.col("place") + 1).cast("int"))


def most_recent(sessions: DataFrame, n: int) -> DataFrame:
    return ordered(sessions, "mtime").limit(n)


def totals(sessions: DataFrame, errors: DataFrame | None = None, filtered_out: Column | None = None) -> DataFrame:
    """One row: sessions, steps, tokens, cost (null if none is known), filtered-out sessions."""
    out = F.lit(False) if filtered_out is None else filtered_out
    kept = ~out
    sums = [
        F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0)).alias(c) for c in ("step_count", "tokens_in", "tokens_out", "cache_read", "cache_create")
    ]
    row = sessions.agg(
        F.count_if(kept).alias("session_count"),
        F.count_if(out).alias("filtered_out_count"),
        *sums,
        F.sum(F.when(kept, F.col("cost_usd"))).alias("cost_usd"),
        F.coalesce(F.sum(F.when(kept, F.col("error_count"))), F.lit(0)).alias("error_count"),
    )
    return row if errors is None else row.join(errors.agg(F.count(F.lit(1)).alias("parse_errors")))


def model_buckets(sessions: DataFrame) -> DataFrame:
    """A session's whole tokens and cost count for every model it used."""
    rows = sessions.withColumn("model", F.explode("models"))
    return (
        rows
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("session_count"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
            F.sum("cost_usd").alias("cost_usd"),
        )
        .orderBy(F.desc("session_count"), "model")
    )


def tool_buckets(stats: DataFrame) -> DataFrame:
    """Uses, errors and sessions of each tool; tools known from results alone count."""
    return (
        stats
        .groupBy("tool_name")
        .agg(F.sum("use_count").alias("use_count"), F.sum("error_count").alias("error_count"), F.count(F.lit(1)).alias("session_count"))
        .orderBy(F.desc("use_count"), "tool_name")
    )


def top_buckets(buckets: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows of model_buckets() or tool_buckets(), in their order."""
    by, name = ("session_count", "model") if "model" in buckets.columns else ("use_count", "tool_name")
    return buckets.orderBy(F.desc(by), name).limit(n)


def format_buckets(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("format").agg(F.count(F.lit(1)).alias("session_count")).orderBy(F.desc("session_count"), "format")


PERCENTILES = (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))


def distributions(sessions: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row with min, p50, p90, p99, max, mean, total of each measure (nearest rank), zeros without sessions.

    Sessions are counted by distinct value, with map-side combining, so that equal values never come
    together; values lie in ranges, and a running count over a row per range finds the range of each rank.
    """
    flags = ("fork_root_count", "annotation_count", "error_count")
    spark = sessions.sparkSession
    valued = F.array(*[F.struct(F.lit(n).alias("m"), c.cast("long").alias("value")) for n, c in measures.items()])
    flagged = F.array(*[F.struct(F.lit(f"_{c}").alias("m"), F.when(F.col(c) > 0, 1).otherwise(0).cast("long").alias("value")) for c in flags])
    counted = sessions.select(F.explode(F.concat(valued, flagged)).alias("v")).filter("v.value is not null").groupBy("v.m", "v.value").agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "m", "value")
    rows = stored(ranged.withColumn("part", F.spark_partition_id()), "counts")
    parts = rows.groupBy("m", "part").agg(F.sum("n").alias("of_part"))
    known = parts.select(
        "m", "part",
        (F.sum("of_part").over(W.partitionBy("m").orderBy("part")) - F.col("of_part")).alias("before"),
        F.sum("of_part").over(W.partitionBy("m")).alias("whole"),
    )
    at = rows.join(F.broadcast(known), ["m", "part"])  # measures times partitions
    upto = F.col("before") + F.sum("n").over(W.partitionBy("m", "part").orderBy("value"))
    at = at.withColumn("upto", upto)
    ranks = {q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("whole") * p)), F.col("value"))) for q, p in PERCENTILES}
    sums = at.groupBy("m").agg(
        F.min("value").alias("min"), *[c.alias(q) for q, c in ranks.items()], F.max("value").alias("max"),
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("mean"), F.sum(F.col("value") * F.col("n")).alias("total"), F.sum("n").alias("count"),
    )
    picked = []
    for n in measures:
        for x in ("min", "p50", "p90", "p99", "max", "mean", "total"):
            kind = "double" if x == "mean" else "long"
            picked.append(F.coalesce(F.max(F.when(F.col("m") == n, F.col(x))), F.lit(0)).cast(kind).alias(f"{n}_{x}"))
    rates = [F.coalesce(F.max(F.when(F.col("m") == f"_{c}", F.col("mean"))), F.lit(0.0)).alias(r) for c, r in zip(flags, ("branched_rate", "annotated_rate", "errored_rate"), strict=True)]
    return sums.agg(F.coalesce(F.max(F.when(F.col("m") == f"_{flags[0]}", F.col("count"))), F.lit(0)).alias("sessions"), *picked, *rates)


def trajectory_stats(sessions: DataFrame) -> DataFrame:
    calls = F.aggregate("tool_stats", F.lit(0).cast("long"), lambda a, t: a + t["use_count"])
    return distributions(
        sessions,
        {"steps": F.col("step_count"), "tool_calls": calls, "tokens_in": F.col("tokens_in"), "tokens_out": F.col("tokens_out")},
    )


def failures(sessions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: tool_errors of all sessions, parse_errors (rows of errors), failed if there is any."""
    zero = F.lit(0).cast("long")
    rows = sessions.select(F.col("error_count").alias("tool_errors"), zero.alias("parse_errors"))
    if errors is not None:
        rows = rows.unionByName(errors.select(zero.alias("tool_errors"), F.lit(1).cast("long").alias("parse_errors")))
    counted = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tool_errors", "parse_errors")])
    return counted.withColumn("failed", (F.col("tool_errors") > 0) | (F.col("parse_errors") > 0))


def fail_on_errored(sessions: DataFrame, parse_errors: int = 0) -> None:
    """Raises if a session failed to parse or a counted tool failed."""
    n = failures(sessions).first()["tool_errors"]
    if parse_errors or n:
        raise RuntimeError(f"{parse_errors} sessions could not be parsed, {n} tool errors")


# comparisons of two runs


def compare_tools(stats_a: DataFrame, stats_b: DataFrame) -> DataFrame:
    """Uses and errors of each tool in runs a and b, their difference, and the side that has it; both have pair_id."""
    a = stats_a.select("pair_id", "tool_name", F.col("use_count").alias("uses_a"), F.col("error_count").alias("errors_a"))
    b = stats_b.select("pair_id", "tool_name", F.col("use_count").alias("uses_b"), F.col("error_count").alias("errors_b"))
    both = a.join(b, ["pair_id", "tool_name"], "full_outer")
    side = F.when(F.col("uses_a").isNull(), "b").when(F.col("uses_b").isNull(), "a").otherwise("both")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "pair_id",
        "tool_name",
        side.alias("side"),
        *[zero(c).alias(c) for c in ("uses_a", "uses_b", "errors_a", "errors_b")],
        (zero("uses_b") - zero("uses_a")).alias("delta"),
    )


def _next_row(row: int, same: int, full: int) -> int:
    """The row after row of the table of common lengths, for a left step that equals the right steps marked in same.

    A row is a number whose bit j is 0 where the length grows at right step j, so that one addition
    carries through all right steps at once.
    """
    met = row & same
    return ((row + met) | (row & ~same)) & full


def align(left: list[str], right: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of a longest common subsequence with gaps; left gaps come first, ties go up in the table.

    Rows of the table of n by m lengths are numbers of m bits. Of them each sqrt(n)-th is kept and the
    rows between are made anew, a block at a time, as the way back passes them. It goes up where the
    length above is the same, that is where the row above has as many steps of growth up to there.
    """
    n, m = len(left), len(right)
    full = (1 << m) - 1
    at: dict[str, list[int]] = {}
    for j, s in enumerate(right):
        at.setdefault(s, []).append(j)
    masks = {}
    for s, js in at.items():
        marks = bytearray((m + 7) // 8)
        for j in js:
            marks[j >> 3] |= 1 << (j & 7)
        masks[s] = int.from_bytes(marks, "little")
    block = max(1, math.isqrt(n))
    row, kept = full, []
    for i, s in enumerate(left):
        if i % block == 0:
            kept.append(row)
        row = _next_row(row, masks.get(s, 0), full)
    matched, i, j = [(n, m)], n, m  # an end mark, then the pairs from the back
    base, table = n, []  # table: the rows from base on

    def row_of(i: int) -> int:
        nonlocal base, table
        if i < base:
            base = i // block * block
            table = [kept[base // block]]
            for k in range(base, min(base + block, n)):
                table.append(_next_row(table[-1], masks.get(left[k], 0), full))
        return table[i - base]

    def grown(row: int, j: int) -> int:
        return j - (row & ((1 << j) - 1)).bit_count()

    here, above = row, row_of(n - 1) if n else full
    length, length_above = grown(here, j), grown(above, j)
    while i and j:
        same = left[i - 1] == right[j - 1]
        if same or length_above == length:  # to the match, or up
            i -= 1
            if same:
                j -= 1
                matched.append((i, j))
            here, above = above, row_of(i - 1) if i else full
            length, length_above = grown(here, j), grown(above, j)
        else:
            j -= 1
            length -= 1 - (here >> j & 1)
            length_above -= 1 - (above >> j & 1)
    out, i, j = [], 0, 0
    for p, q in reversed(matched):
        out += [(k, None) for k in range(i, p)] + [(None, k) for k in range(j, q)] + [(p, q)]
        i, j = p + 1, q + 1
    return out[:-1]


ALIGNED = "pair_id string, row_no int, left_idx int, right_idx int, align_kind string"


def align_sessions(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Alignment rows of session pairs (pair_id, left_id, right_id); steps match by kind and tool, and are equal by detail.

    Two sessions travel as arrays in one row; a pair costs time with a 64th of the product of their lengths, and memory with
    an eighth of the length of one times the square root of the other's.
    """
    signed = steps.select(
        "session_id",
        (
            F.struct("step_index", F.concat_ws("\x1f", "kind", F.coalesce("tool_name", F.lit("\x1e"))).alias("sig"), F.md5("detail").alias("d"))
            .alias("s")
        ),
    )
    arrays = signed.groupBy("session_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    side = lambda name: arrays.select(F.col("session_id").alias(f"{name}_id"), F.col("s.sig").alias(f"{name}_sig"), F.col("s.d").alias(f"{name}_d"))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id").select("pair_id", "left_sig", "left_d", "right_sig", "right_d")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = align(list(r.left_sig), list(r.right_sig))
                kind = ["left_only" if j is None else "right_only" if i is None else "match" if r.left_d[i] == r.right_d[j] else "differ" for i, j in rows]
                yield pd.DataFrame(
                    {
                        "pair_id": r.pair_id,
                        "row_no": range(len(rows)),
                        "left_idx": pd.array([i for i, _ in rows], "Int32"),
                        "right_idx": pd.array([j for _, j in rows], "Int32"),
                        "align_kind": kind,
                    }
                )

    return both.mapInPandas(run, ALIGNED)


def align_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pair_id").agg(*[F.count_if(F.col("align_kind") == k).alias(k) for k in ("match", "differ", "left_only", "right_only")])


# similarity


def nearest(vectors: DataFrame, query: list[float], top: int = 30, least: float = 0.25) -> DataFrame:
    """Rows (id, embedding) by their dot product with a query vector, best first; other lengths score 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.select("id", F.when(F.size("embedding") == len(query), dot).otherwise(0.0).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(top)


#: Most vectors of a block, and about the most of a partition of blocks, in searches with many queries.
BLOCK, DEALT = 1024, 4096


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Rows (id, embedding) packed by up to BLOCK into one binary value each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = pa.Table.from_batches([batch.slice(at, BLOCK)])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_table(own)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // DEALT))
    return rows.select("id", "embedding").repartition(n).mapInArrow(pack, f"{name} binary")


def _unpacked(block: bytes) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids, and by length the places and values of the vectors; null ones have length -1."""
    table = pa.ipc.open_stream(block).read_all()
    vectors = table.column("embedding").to_pylist()
    places: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        places.setdefault(-1 if v is None else len(v), []).append(i)
    return (
        table
        .column("id")
        .to_numpy(), {n: (np.array(own), np.array([vectors[i] for i in own], float).reshape(len(own), -1)) for n, own in places.items()}
    )


def _best(queries: bytes, rows: bytes, top: int, least: float) -> Iterator[tuple[int, int, float]]:
    """query_id, id, score of the best rows of a block for each query of a block; ties by id."""
    (query_ids, asked), (ids, held) = _unpacked(queries), _unpacked(rows)
    for n, (own, values) in asked.items():
        at, vectors = held[n] if n > 0 and n in held else (np.zeros(0, int), None)
        known = np.zeros((len(own), len(ids)))  # other lengths score 0
        if len(at):
            known[:, at] = np.nan_to_num(values @ vectors.T, nan=-np.inf)
        place = np.full(len(ids), -1)
        place[at] = np.arange(len(at))
        for k, q, about in zip(own, values, known, strict=True):
            bar = max(least, np.partition(about, len(about) - top)[len(about) - top]) if len(about) > top else least
            near = np.flatnonzero(about >= bar - 1e-9)
            same = near[place[near] >= 0]
            exact = np.zeros(len(ids))
            if len(same):
                exact[same] = np.cumsum(vectors[place[same]] * q, axis=1)[:, -1]  # in order, so that equal vectors tie
            near = near[exact[near] >= least]
            for i in near[np.lexsort((ids[near], -exact[near]))][:top]:
                yield int(query_ids[k]), int(ids[i]), float(exact[i])


def nearest_of_each(vectors: DataFrame, queries: DataFrame, top: int = 30, least: float = 0.25) -> DataFrame:
    """query_id, id, score: what nearest() gives for each query; both have rows (id, embedding).

    Blocks of queries meet blocks of vectors; of each such pair the best rows are kept, and of those the best of all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, rows in zip(batch["q"], batch["rows"], strict=True):
                yield pd.DataFrame(list(_best(q, rows, top, least)), columns=["query_id", "id", "score"])

    found = _blocks(vectors, "rows").crossJoin(_blocks(queries, "q")).mapInPandas(run, "query_id long, id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= top).drop("place")


# notes


def upsert_notes(edits: DataFrame) -> DataFrame:
    """The notes left after edits (session_id, step_index, text, at_ms): blank text deletes, the same text changes nothing.

    A note is created when it appears after nothing or a deletion, and updated at its last change.
    """
    w = W.partitionBy("session_id", "step_index").orderBy("at_ms")
    rows = (
        edits
        .withColumn("text", F.trim("text"))
        .withColumn("same", F.col("text").eqNullSafe(F.lag("text").over(w)))
        .filter("not same")
        .drop("same")
    )
    rows = (
        rows
        .withColumn("life", F.sum(F.when(F.col("text") == "", 1).otherwise(0)).over(w))
        .withColumn("last_life", F.max("life").over(W.partitionBy("session_id", "step_index")))
    )
    left = rows.filter("life = last_life and text <> ''")
    return (
        left
        .groupBy("session_id", "step_index")
        .agg(F.max_by("text", "at_ms").alias("text"), F.min("at_ms").alias("created_at_ms"), F.max("at_ms").alias("updated_at_ms"))
    )


def with_notes(steps: DataFrame, notes: DataFrame) -> DataFrame:
    return steps.join(notes.select("session_id", "step_index", F.col("text").alias("note")), ["session_id", "step_index"], "left")
