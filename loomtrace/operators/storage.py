"""Tables written to the folder that driver and executors share, and numbering of rows by range partitions."""

from __future__ import annotations

import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Used on one machine alone (tests, bench), where the session names no shared folder.
ONE_MACHINE = "file:///tmp/loomtrace-shared"
#: Spark's setting that drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one, what executors write could not be read elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return ONE_MACHINE  # the driver is the only executor
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/loomtrace-{name}-{uuid.uuid4().hex}"


#: Per session: how many threads are inside own_shuffles(), and the setting before the first came.
_INSIDE: weakref.WeakKeyDictionary[SparkSession, tuple[int, str]] = weakref.WeakKeyDictionary()
_LOCK = threading.Lock()


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends: its result is written, nobody reads them again.

    Threads of one session may be inside together: the last to leave restores the setting.
    """
    with _LOCK:
        n, was = _INSIDE.get(spark) or (0, spark.conf.get(CLEANUP, "false"))
        _INSIDE[spark] = n + 1, was
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, was = _INSIDE.pop(spark)
            if n > 1:
                _INSIDE[spark] = n - 1, was
            else:
                spark.conf.set(CLEANUP, was)


#: Where each stored table lies.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and losing executors loses nothing.

    With by, a folder for each value of that column. discard() drops the table when its last reader
    is done; the session's clean-up of the shared folder removes the rest.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    with own_shuffles(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empties stored tables that nothing reads any more."""
    for df in tables:
        df.limit(0).write.mode("overwrite").parquet(_PATHS.pop(df))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with place, the number (from 0) of each row in that order, by range partitions: no task sees all rows.

    A row's number is its number within its partition and the rows of the partitions before; the
    table of those has a row per partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), part == F.col("_part")).withColumn("place", F.col("_before") + within).drop("_at", "_part", "_before")
