"""Adapters from tables to steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions.steps import RATES, STEP_COLUMNS, detail, label
from loomtrace.operators.sessions import paired

#: Tools and models that events are mapped to.
TOOLS = ("Read", "Edit", "Bash", "Grep", "Write", "WebFetch")
MODELS = (*[r[0] for r in RATES], "unpriced-model")
STEP_NAMES = [c.split()[0] for c in STEP_COLUMNS.split(", ")]


def _pick(names: tuple[str, ...], n):
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def event_parts(events: DataFrame) -> DataFrame:
    """Events as raw steps: session, position, kind, text or tool with call id, input and result, model and counters."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = (
        F.when(F.col("event_type") == "view", "user_text")
        .when(F.col("event_type") == "signup", "assistant_text")
        .when(F.col("event_type") == "click", "tool_use")
        .otherwise("tool_result")
    )
    rows = events.select(
        F.col("user_id").cast("string").alias("session_id"), F.struct("ts", "event_id").alias("position"), "event_id", "event_type", kind.alias("kind"), k.alias("k"),
        F.floor(F.col("value")).cast("long").alias("v"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("timestamp_ms"),
    )
    said, asst, use, result = (F.col("kind") == x for x in ("user_text", "assistant_text", "tool_use", "tool_result"))
    text = F.when(said, F.concat(F.lit("please view item "), F.col("k"))).when(asst, F.concat(F.lit("signed up with plan "), F.col("k")))
    outcome = (
        F.when(
            F.col("event_type") == "error",
            F.when(F.col("k") % 2 == 0, F.concat(F.lit("Error: no item "), F.col("k"))).otherwise(F.concat(F.lit("exit code "), F.col("k") % 3)),
        )
        .otherwise(F.concat(F.lit("bought "), F.col("v")))
    )
    return rows.select(
        "session_id", "position", "event_id", "kind", text.alias("text"), F.when(use, _pick(TOOLS, F.col("k"))).alias("tool_name"),
        F.when(use | result, F.concat(F.lit("call-number-"), F.col("k"))).alias("tool_call_id"),
        F.when(use, F.concat(F.lit('{"command":"job '), F.col("k"), F.lit('"}'))).alias("input_text"), F.when(result, outcome).alias("result_text"), "timestamp_ms",
        F.when(asst, _pick(MODELS, F.col("event_id"))).alias("model"), F.when(asst, F.col("v") * 10).alias("tokens_in"), F.when(asst, F.col("v")).alias("tokens_out"),
        F.when(asst, F.col("event_id") % 50).alias("cache_read"), F.when(asst & (F.col("event_id") % 7 > 0), F.col("event_id") % 7).alias("cache_create"),
    )


def finish(parts: DataFrame, fmt: str) -> DataFrame:
    """Numbers, labels and details of raw steps whose results are paired; the columns of the steps table."""
    c, order = F.col, W.partitionBy("session_id").orderBy("position")
    gap = c("timestamp_ms") - F.lag("timestamp_ms").over(order)
    numbered = parts.withColumns({"step_index": (F.row_number().over(order) - 1).cast("int"), "duration_ms": F.when(gap >= 0, gap)})
    full = numbered.withColumns({
        "label": label(c("kind"), c("text"), c("tool_name"), c("tool_call_id"), c("result_text")),
        "detail": detail(c("kind"), c("text"), c("tool_name"), c("tool_call_id"), c("input_text"), c("result_text")),
        "format": F.lit(fmt),
        **({} if "is_fork_root" in parts.columns else {"is_fork_root": F.lit(False)}),
    })
    return full.select(*STEP_NAMES)


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user of the events table."""
    return finish(paired(event_parts(spark.read.parquet(f"{sf_dir}/events.parquet"))), "generic")


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per conversation; system turns are dropped, times and tools unknown."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role in ('user', 'assistant')")
    none = {n: F.lit(None).cast(t) for n, t in (x.split() for x in STEP_COLUMNS.split(", ")) if n in ("tool_name", "tool_call_id", "input_text", "result_text", "timestamp_ms", "model", "tokens_in", "tokens_out", "cache_read", "cache_create")}
    parts = (
        turns
        .select(
            F.col("conv_id").cast("string").alias("session_id"),
            F.col("turn").alias("position"),
            F.concat("role", F.lit("_text")).alias("kind"),
            "text",
        )
        .withColumns(none)
    )
    return finish(parts, "generic")
