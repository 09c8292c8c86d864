"""Streams of step rows: new errors, idle sessions, running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.steps import is_error
from loomtrace.operators.storage import fresh_path


def new_errors(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Error results as they arrive; rows delivered again within the watermark are dropped. stream has a timestamp `at`.

    A row older than the watermark when its batch arrives is dropped: input must come in the order of
    time up to `late`, or `late` must span what the files of one run spread over.
    """
    once = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["session_id", "step_id"])
    return once.filter(is_error(F.col("kind"), F.col("detail"))).select("session_id", "step_id", "at", F.substring("detail", 1, 200).alias("preview"))


def idle_sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """One row per session and spell of activity, once no step has followed for the gap."""
    spell = F.session_window("at", gap)
    return (
        stream
        .withWatermark("at", late)
        .groupBy("session_id", spell)
        .agg(F.count(F.lit(1)).alias("steps"))
        .select("session_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("idle_at"), "steps")
    )


def live_totals(stream: DataFrame) -> DataFrame:
    """Running steps and errors per session and tool (complete or update mode)."""
    return (
        stream
        .groupBy("session_id", "tool_name")
        .agg(F.count(F.lit(1)).alias("steps"), F.count_if(is_error(F.col("kind"), F.col("detail"))).alias("errors"))
    )


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream (append or complete mode) has written once all of its present input is read.

    State and output lie in the shared folder, which the session's clean-up empties.
    """
    path = fresh_path(spark, "stream")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append")
    elif mode != "complete":
        raise ValueError(f"mode {mode}: batches would overwrite each other")
    else:

        def last(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")  # the whole table each time

        writer = stream.writeStream.foreachBatch(last).outputMode(mode)
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def event_stream(spark: SparkSession, sf_dir: str, steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The events table as a stream of step rows (at, session_id, step_id, kind, detail, tool_name)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return steps(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
