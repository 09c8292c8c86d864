"""Helpers shared by the corpus operators: reading tables, cutting lineage, word splitting."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators.storage import discard, fresh_path, numbered, own_shuffles, shared_folder, stored

__all__ = ["ascii_lower", "discard", "documents", "drop_buckets", "join_heavy", "numbered", "semi_heavy", "shared_folder", "slices", "spread", "stored", "stored_by", "words"]

#: Fixed by the contracts: a word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, narrowed to the given columns (all without any)."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def stored_by(df: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """As stored, in n buckets of key, so that later joins on key don't move these rows again. df lies in n partitions of key already."""
    spark = df.sparkSession
    table, path = f"loomtrace_{name}_{uuid.uuid4().hex}", fresh_path(spark, name)
    with own_shuffles(spark):
        df.write.bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    out = spark.table(table)
    _BUCKETED[out] = (table, path)
    return out


#: Name and path of each table in buckets.
_BUCKETED: weakref.WeakKeyDictionary[DataFrame, tuple[str, str]] = weakref.WeakKeyDictionary()


def drop_buckets(df: DataFrame) -> None:
    """Drops a table of stored_by() that nothing reads any more."""
    table, path = _BUCKETED.pop(df)
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    df.sparkSession.sql(f"DROP TABLE {table}")


#: A key with more than a HEAVY-th of the rows is hot; fewer than HEAVY keys can be.
HEAVY = 2_000


def join_heavy(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "left") -> DataFrame:
    """left joined (left or inner) with right, whose rows have distinct keys and the number of left rows of each as weight.

    Hot keys, fewer than HEAVY by their definition, are joined by broadcast, so that no task gathers
    a hot key's rows; null keys meet nothing and aren't moved. Both tables are read more than once:
    store them first.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * HEAVY > total
    heavy, light = right.filter(hot), right.filter(~hot)
    known = left.dropna(subset=on)
    out = known.join(F.broadcast(heavy), on)
    out = out.unionByName(known.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on, how))
    if how == "inner":
        return out
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    return out.unionByName(left.filter(null), allowMissingColumns=True)


#: Tasks that a hot key's rows are dealt out to.
SALTS = 64


def semi_heavy(left: DataFrame, right: DataFrame, key: str, weight: str, by: str) -> DataFrame:
    """The rows of left whose key is in right, whose rows have distinct keys and the number of left rows of each as weight.

    Rows of hot keys, fewer than HEAVY, are dealt out over SALTS tasks by a hash of column by. left is
    read once; right is read more often: store it first.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * HEAVY > total
    marks = F.broadcast(right.filter(hot).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0)
    salted = left.join(marks, key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    keys = right.select(key, F.explode(salts.cast("array<long>")).alias("_salt"))
    return salted.join(keys, [key, "_salt"], "left_semi").drop("_salt")


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with up to so many bytes of text in a column, a row at least, so that Python holds few texts at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """All words of a text, [] for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as the session's parallelism, so that few large files don't leave cores idle."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
