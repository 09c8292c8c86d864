"""Notes kept beside session files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDECAR = "version int, path string, notes map<string, struct<text: string, created_at_ms: bigint, updated_at_ms: bigint>>"


def sidecar_notes(files: DataFrame) -> DataFrame:
    """session_id, key, step_index, text, created_at_ms, updated_at_ms of the notes in sidecar files (path, content).

    session_id is the path that a sidecar names, else its own. A malformed sidecar has no notes. A key
    that is no step number counts as a note of its session but has a null step_index, so that it
    meets no step.
    """
    read = files.select("path", F.from_json(F.col("content").cast("string"), SIDECAR, {"mode": "PERMISSIVE"}).alias("s"))
    whole = F.forall(F.map_values("s.notes"), lambda n: n["text"].isNotNull() & n["created_at_ms"].isNotNull() & n["updated_at_ms"].isNotNull())
    notes = read.filter(whole).select(F.coalesce(F.nullif("s.path", F.lit("")), "path").alias("session_id"), F.explode("s.notes").alias("key", "n"))
    number = F.when(F.col("key").rlike(r"^\+?[0-9]+$"), F.expr("try_cast(key as int)"))
    return notes.select("session_id", "key", number.alias("step_index"), "n.text", "n.created_at_ms", "n.updated_at_ms")
