"""Front doors: sessions from files, and scans of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions import pii
from loomtrace.operators import sessions as ops
from loomtrace.sources import formats, notes


def load_steps(spark: SparkSession, path: str) -> DataFrame:
    """The steps of a session file, or of all session files in a folder."""
    return formats.parse(formats.read_files(spark, path))


def load_corpus(spark: SparkSession, folder: str, sidecars: str | None = None) -> DataFrame:
    """A row per session file of a folder, without steps, then a row with path and error alone per file that can't be parsed.

    sidecars is the folder of notes, if there is one.
    """
    files = formats.read_files(spark, folder)
    steps, errors = formats.parse(files), formats.parse_errors(files)
    mtimes = files.select(F.col("path").alias("session_id"), "mtime_secs")
    noted = notes.sidecar_notes(formats.read_files(spark, sidecars)) if sidecars else None
    rows = ops.sessions(steps, noted, mtimes).withColumnRenamed("session_id", "path").drop("last_ms")
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True).orderBy(F.col("error").isNotNull(), "path")


def scan_pii(spark: SparkSession, text: str) -> DataFrame:
    """category, step_index (0), snippet of what a text holds; loomtrace.functions.pii.scan_pii scans columns."""
    found = pii.scan_pii(spark.createDataFrame([(0, text)], "step_index int, text string"), "text")
    return found.select("category", "step_index", "snippet")
