"""Registered queries: each applies an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import pii
from loomtrace.functions import steps as fs
from loomtrace.operators import corpus, export, vector_index
from loomtrace.operators import sessions as ops
from loomtrace.plans import raw
from loomtrace.plans.oracle_more import ORACLE_SQL
from loomtrace.sources import adapters, drift, formats, notes
from loomtrace.operators.storage import discard, fresh_path, stored
from loomtrace.streaming import live, watch

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _steps(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(adapters.event_steps(spark, d))


def _sessions(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _steps(lambda s: f(ops.sessions(s)))


def _place(mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return corpus.placed(ops.sessions(adapters.event_steps(spark, d)), mode).select("session_id", "place")

    return run


def _listed(s: DataFrame) -> DataFrame:
    calls = F.aggregate("tool_stats", F.lit(0).cast("long"), lambda a, t: a + t["use_count"])
    return s.select(
        "session_id",
        "format",
        "step_count",
        "tokens_in",
        "tokens_out",
        "cache_read",
        "cache_create",
        "cost_usd",
        *[f"n_{k}" for k in ops.KINDS],
        F.array_join("models", ",").alias("models"),
        "error_count",
        calls.alias("tool_calls"),
        "mtime_secs",
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("cost_usd", F.round("cost_usd", 6))


def _forks(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    entries = e.select(
        F.col("event_id").alias("entry"),
        F.col("user_id").cast("string").alias("session_id"),
        F.floor(F.col("event_id") / 300).alias("parent"),
        F.lit(True).alias("first"),
    )
    return ops.fork_flags(entries).select("entry", "session_id", "is_fork_root")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    stats = ops.tool_stats(adapters.event_steps(spark, d))
    side = lambda r: stats.filter(F.col("session_id").cast("long") % 2 == r).withColumn("pair_id", F.floor(F.col("session_id").cast("long") / 2))
    return corpus.compare_tools(side(0), side(1))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Alignment counts of every session with the next one by number."""
    steps = adapters.event_steps(spark, d)
    ids = steps.select("session_id").distinct()
    pairs = ids.select(
        F.concat_ws(":", "session_id", (F.col("session_id").cast("long") + 1).cast("string")).alias("pair_id"),
        F.col("session_id").alias("left_id"),
        (F.col("session_id").cast("long") + 1).cast("string").alias("right_id"),
    )
    return corpus.align_counts(corpus.align_sessions(steps, pairs))


def _nearest_of_each(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of every row whose id is divisible by 50."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return corpus.nearest_of_each(e, e.filter("id % 50 = 0")).withColumn("score", F.round("score", 6))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """As nearest_vectors_all, by an inverted-file index over all rows."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    lists = vector_index.fit(e)
    found = vector_index.search(vector_index.index(e, lists), e.filter("id % 50 = 0"), lists)
    return found.withColumn("score", F.round("score", 6))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    edits = e.select(
        F.col("user_id").cast("string").alias("session_id"),
        (F.get_json_object("props", "$.k").cast("long") % 5).cast("int").alias("step_index"),
        F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("text"),
        F.col("event_id").alias("at_ms"),
    )
    return corpus.upsert_notes(edits)


def _pii(spark: SparkSession, d: str) -> DataFrame:
    """Matches in documents, each with two keys of its own added."""
    key = F.md5(F.col("doc_id").cast("string"))
    text = F.concat("text", F.lit(" AKIA"), F.upper(F.substring(key, 1, 20)), F.lit(" sk-ant-"), key, F.lit("abc"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.alias("text"))
    return pii.scan_pii(docs, "text").drop("field")


def _ipv4(spark: SparkSession, d: str) -> DataFrame:
    return pii.scan_pii(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text").filter("category = 'ipv4'").drop("field")


def _pii_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Matches in documents, each with a value of every kind added; in a third of them the values are one sign too short."""
    key, longer = F.repeat(F.md5(F.col("doc_id").cast("string")), F.lit(2)), F.col("doc_id") % 3 - 1
    tail = lambda n: F.substring(key, F.lit(1), (longer + n).cast("int"))
    added = [F.concat(F.lit(f" {gate}"), tail(least)) for (_, _, gate), least in zip(pii.PREFIXED, pii.LEAST, strict=True) if gate != "eyJ"]
    added.append(F.concat(F.lit(" eyJ"), tail(13), F.lit("."), tail(16), F.lit("."), tail(16)))
    added.append(F.concat(F.lit(" 10."), F.col("doc_id") % 300, F.lit(".7."), F.col("doc_id") % 9))
    added.append(F.concat(F.lit("\n"), F.element_at(F.array(*map(F.lit, pii.KEY_HEADERS)), (F.col("doc_id") % len(pii.KEY_HEADERS) + 1).cast("int"))))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat("text", *added).alias("text"))
    return pii.scan_pii(docs, "text").drop("field")


def _pii_report(spark: SparkSession, d: str) -> DataFrame:
    docs = (
        spark.read
        .parquet(f"{d}/documents.parquet")
        .select(F.col("doc_id").cast("string").alias("session_id"), F.lit(0).alias("step_index"), F.col("text").alias("detail"))
    )
    return pii.scan_report(pii.scan_pii(docs, "detail"))


def _docs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(spark.read.parquet(f"{d}/documents.parquet"))


def _raw(files: Query) -> Query:
    return lambda spark, d: formats.parse(files(spark, d)).select("session_id", "step_index", "kind", "detail")


def _drift(spark: SparkSession, d: str) -> DataFrame:
    found = drift.drift_report(formats.detect(raw.event_files(spark, d)))
    return found.withColumn("first_positions", F.array_join("first_positions", ","))


def _parse_errors(spark: SparkSession, d: str) -> DataFrame:
    return formats.parse_errors(raw.event_files(spark, d))


def _fork_indices(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("session_id").orderBy("entry")
    numbered = _forks(spark, d).withColumn("step_index", (F.row_number().over(order) - 1).cast("int"))
    return ops.fork_root_indices(numbered).withColumn("fork_root_indices", F.array_join("fork_root_indices", ","))


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with notes, as the session rows count them."""
    rows = ops.sessions(adapters.event_steps(spark, d), _notes(spark, d))
    return rows.filter(corpus.matches(annotated=True)).select("session_id", "step_count", "annotation_count")


def _noted_steps(spark: SparkSession, d: str) -> DataFrame:
    found = corpus.with_notes(adapters.event_steps(spark, d), _notes(spark, d))
    return found.filter("note is not null").select("session_id", "step_index", "kind", "note")


def _document(spark: SparkSession, d: str) -> DataFrame:
    """The corpus document of errored sessions, with files that can't be parsed, read back."""
    sessions, errors = ops.sessions(adapters.event_steps(spark, d)), _parse_errors(spark, d)
    got = export.corpus_document(sessions, errors, corpus.matches(errored=True))
    whole = (
        "file_count",
        "parse_success_count",
        "parse_error_count",
        "filtered_out_count",
        "total_steps",
        "total_tokens_in",
        "total_tokens_out",
        "total_cache_read",
        "total_cache_create",
    )
    number = lambda name, kind="long": F.get_json_object("document", f"$.{name}").cast(kind).alias(name)
    model = F.from_json(
        F.get_json_object("document", "$.per_model"),
        "array<struct<model: string, session_count: long, tokens_in: long, tokens_out: long>>",
    )
    return got.select(
        *map(number, whole),
        number("total_cost_usd", "double"),
        F.to_json(model).alias("per_model"),
        *[F.get_json_object("document", f"$.per_{x}").alias(f"per_{x}") for x in ("tool", "format")],
    )


def _failures(spark: SparkSession, d: str) -> DataFrame:
    return corpus.failures(ops.sessions(adapters.event_steps(spark, d)), _parse_errors(spark, d))


def _json_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of sessions with their notes, read back: sums, models, a line per step and per note."""
    steps, noted = adapters.event_steps(spark, d), _notes(spark, d)
    found = export.json_documents(steps, ops.sessions(steps), noted)
    kind = (
        "totals struct<tokens_in: long, tokens_out: long, cache_read: long, cache_create: long, models: array<string>>, "
        "steps array<struct<step_index: int, kind: string, label: string, tool_name: string, tool_call_id: string, duration_ms: long>>, "
        "annotations array<struct<step_index: int, text: string>>"
    )
    row = found.select("session_id", F.from_json("document", kind).alias("d"))
    listed = lambda items, *names: F.array_join(F.transform(items, lambda x: F.concat_ws(":", *[F.coalesce(x[n].cast("string"), F.lit("-")) for n in names])), "\n")
    return row.select(
        "session_id",
        *[F.col(f"d.totals.{c}").alias(c) for c in ("tokens_in", "tokens_out", "cache_read", "cache_create")],
        F.array_join("d.totals.models", ",").alias("models"),
        listed("d.steps", "step_index", "kind", "label", "tool_name", "tool_call_id", "duration_ms").alias("steps"),
        listed("d.annotations", "step_index", "text").alias("notes"),
    )


def _session_lines(sessions: DataFrame) -> DataFrame:
    tools = F.transform("tool_counts", lambda t: F.concat(t["name"], F.lit(":"), t["count"]))
    return _rounded(export.session_lines(sessions)).withColumns({"models": F.array_join("models", ","), "tool_counts": F.array_join(tools, ",")})


def _stream_rows(spark: SparkSession, d: str) -> DataFrame:
    def rows(events: DataFrame) -> DataFrame:
        p = adapters.event_parts(events)
        full = fs.detail(F.col("kind"), F.col("text"), F.col("tool_name"), F.col("tool_call_id"), F.col("input_text"), F.col("result_text"))
        return p.select(
            "session_id",
            F.col("event_id").alias("step_id"),
            F.timestamp_millis("timestamp_ms").alias("at"),
            "kind",
            full.alias("detail"),
            "tool_name",
        )

    return live.event_stream(spark, d, rows)


def _stream_errors(spark: SparkSession, d: str) -> DataFrame:
    return live.drained(spark, live.new_errors(_stream_rows(spark, d)), "append").select("session_id", "step_id")


def _stream_idle(spark: SparkSession, d: str) -> DataFrame:
    idle = live.drained(spark, live.idle_sessions(_stream_rows(spark, d)), "append")
    return idle.select("session_id", F.unix_millis("started").alias("started_ms"), F.unix_millis("idle_at").alias("idle_ms"), "steps")


def _idle_alerts(spark: SparkSession, d: str) -> DataFrame:
    child = watch.with_state_store(spark)
    return live.drained(child, watch.idle_alerts(_stream_rows(child, d), 21_600_000), "append")


#: What each look at a growing file finds of its n messages: half, all, a third (the file was cut), all again.
LOOKS = ("n div 2", "n", "n div 3", "n")


def _grown_errors(spark: SparkSession, d: str) -> DataFrame:
    """New errors of files that grow, are cut and grow again between looks."""
    child = watch.with_state_store(spark)
    spool, messages = fresh_path(child, "spool"), stored(raw.chat_messages(child, d), "chats")
    for version, part in enumerate(LOOKS):
        watch.snapshot(raw.chats(messages, part), version, spool)
    discard(messages)
    found = live.drained(child, watch.grown_errors(watch.spool_stream(child, spool)), "append")
    return found.select("session_id", "version", "step_index", "label")


def _with_tools(files: Query, *more: str) -> Query:
    """Sessions with tools, usage and models, written as files and read back."""
    columns = ("session_id", "step_index", "kind", "tool_name", "tool_call_id", "model", "tokens_in", "tokens_out", "cache_read", "label")
    return lambda spark, d: formats.parse(files(spark, d)).select(*columns, *more)


def _stream_totals(spark: SparkSession, d: str) -> DataFrame:
    return live.drained(spark, live.live_totals(_stream_rows(spark, d)), "complete")


QUERIES: dict[str, Query] = {
    "event_steps": lambda spark, d: adapters.event_steps(spark, d),
    "conversation_steps": lambda spark, d: adapters.conversation_steps(spark, d).select("session_id", "step_index", "kind", "detail"),
    "raw_generic_steps": _raw(raw.generic),
    **{f"raw_{name}_steps": _raw(files) for name, files in raw.FILES.items()},
    "raw_tool_chats": _with_tools(raw.tool_chats),
    "raw_tool_traces": _with_tools(raw.tool_traces, "timestamp_ms", "duration_ms", "cache_create", "is_fork_root", "result_text"),
    "raw_tool_rollouts": _with_tools(raw.tool_rollouts, "timestamp_ms", "duration_ms", "result_text"),
    "raw_tool_messages": _with_tools(raw.tool_messages, "timestamp_ms", "result_text"),
    "parse_errors": _parse_errors,
    "drift_report": _drift,
    "sidecar_notes": lambda spark, d: notes.sidecar_notes(raw.sidecars(spark, d)),
    "tool_buckets": _steps(lambda s: corpus.tool_buckets(ops.tool_stats(s))),
    "tool_stats": _steps(ops.tool_stats),
    "sessions": _sessions(_listed),
    "step_costs": _steps(lambda s: fs.with_cost(s).filter("model is not null").select("session_id", "step_index", "model", "cost_usd")),
    "corpus_totals": _sessions(lambda s: _rounded(corpus.totals(s, filtered_out=~corpus.matches(errored=True)))),
    "model_buckets": _sessions(lambda s: _rounded(corpus.model_buckets(s))),
    "format_buckets": _sessions(corpus.format_buckets),
    "trajectory_stats": _sessions(corpus.trajectory_stats),
    "sessions_by_model": _sessions(lambda s: s.filter(corpus.matches(model="gpt-5")).select("session_id")),
    "sessions_by_tool": _sessions(lambda s: s.filter(corpus.matches(tool="bash")).select("session_id")),
    "sessions_errored": _sessions(lambda s: s.filter(corpus.matches(errored=True)).select("session_id", "error_count")),
    **{f"order_by_{m}": _place(m) for m in ("mtime", "cost", "errors", "tokens", "format")},
    "most_recent_sessions": _sessions(lambda s: corpus.most_recent(s, 25).select("session_id", "mtime_secs")),
    "top_tools": _steps(lambda s: ops.top_tools(s).select("session_id", "tool_name", "use_count", "rank")),
    "recent_errors": _steps(ops.recent_errors),
    "slice_steps": _steps(lambda s: ops.slice_steps(s, 3, 10).select("session_id", "step_index", "label")),
    "slice_time": _steps(lambda s: ops.slice_time(s, 3_600_000, 90_000_000).select("session_id", "step_index", "label")),
    "first_at": _steps(lambda s: ops.first_at(s, 7_200_000)),
    "label_filter": _steps(lambda s: ops.label_filter(s, " Grep").select("session_id", "step_index", "label")),
    "search": _steps(lambda s: ops.search(s, "item 4")),
    "conversation_view": _steps(lambda s: ops.conversation(s).select("session_id", "step_index", "detail")),
    "tool_density": _steps(ops.tool_density),
    "parallel_batches": _steps(ops.parallel_batches),
    "text_context": _steps(ops.text_context),
    "fork_flags": _forks,
    "fork_root_indices": _fork_indices,
    "top_models": _sessions(lambda s: _rounded(corpus.top_buckets(corpus.model_buckets(s)))),
    "top_tools_of_corpus": _steps(lambda s: corpus.top_buckets(corpus.tool_buckets(ops.tool_stats(s)))),
    "corpus_document": _document,
    "annotated_sessions": _annotated,
    "steps_with_notes": _noted_steps,
    "compare_tools": _pairs,
    "align_sessions": _aligned,
    "nearest_vectors_all": _nearest_of_each,
    "nearest_vectors_indexed": _indexed,
    "upsert_notes": _notes,
    "pii_scan": _pii,
    "pii_ipv4": _ipv4,
    "pii_kinds": _pii_kinds,
    "pii_report": _pii_report,
    "redact": _docs(lambda x: x.select("doc_id", fs.redact(F.col("text"), ["the", "", "que"]).alias("text"))),
    "previews": _docs(lambda x: x.select("doc_id", fs.truncate(F.col("text"), 60).alias("preview"))),
    "trajectory_lines": _steps(export.trajectories),
    "markdown": _steps(export.markdown),
    "json_documents": _json_documents,
    "failures": _failures,
    "first_labels": _steps(lambda s: ops.first_labels(s).withColumn("labels", F.array_join("labels", "\n"))),
    "html": _steps(export.html),
    "session_lines": _sessions(_session_lines),
    "shell_commands": _steps(lambda s: s.filter("kind = 'tool_use'").select("session_id", "step_index", fs.shell_command(F.col("tool_name"), F.col("input_text")).alias("command")).filter("command is not null")),
    "stream_errors": _stream_errors,
    "stream_idle": _stream_idle,
    "stream_totals": _stream_totals,
    "stream_idle_alerts": _idle_alerts,
    "stream_grown_errors": _grown_errors,
}
