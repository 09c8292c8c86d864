"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its words first gets floor(r) certain whole copies of every
document. The rest, a fraction f of its words, is a Pareto sample: documents are ranked by the
random odds u / (1 - u) divided by their inclusion odds, and the lowest ranks are taken until the
sample has its fixed size in words. Inclusion odds are f / (1 - f), tilted towards documents near
the source's mean length or below it, so that no huge document spoils the cut.

The cut is found by radix refinement: words per (source, rank bucket) are added up, the bucket that
holds the cut is split anew, and only the last bucket's documents are ordered one by one. No task
sees more than BUCKETS sums of a source, however hot the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import documents, numbered, stored, words

#: Weights of sources by code point order, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's words.
MOST_REPEATS = 3
BUCKETS = 4096
#: Inclusion odds are finite: rounding must not make a part of 1.
MOST_PART = 0.999999999
LEVELS = 2
#: Bounds of the tilt of inclusion odds by length.
TILT = (0.25, 4.0)


def uniform(doc_id: Column) -> Column:
    """A uniform number in (0, 1) that depends on the id alone."""
    return (F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, n, target from rows (source, size).

    Water filling: targets are min(most * source_size, level * weight), and level is such that they
    add up to all words. It rises until no further source is capped; the driver sees two sums a round.
    Sources are numbered by range partitions, so that no task holds all of them.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = numbered(by_source, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("source", "source_size", "n", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    total, weight_left = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total / weight_left if total else 0.0), None
    while level != before:
        before, full = level, F.col("cap") < F.lit(level) * F.col("weight")
        capped, weight_left = sources.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        level = (total - capped) / weight_left if weight_left else level
    share = F.lit(level) * F.col("weight")
    return sources.select("source", "source_size", "n", F.when(share >= F.col("cap"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def source_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """A row per source (source, source_size, n, target, whole, part, cut_rank, cut_id) from stored rows (doc_id, source, size).

    whole certain copies go to every document; of the part, documents up to the cut get one more.
    """
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    targets = (
        source_targets(sized, weights, most)
        .withColumn("whole", F.floor(ratio))
        .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    targets = stored(targets, "targets")
    ranked = stored(
        _of_source(sized, targets).withColumn("rank", _rank()).filter("rank is not null").select("doc_id", "source", "size", "rank", "part"),
        "ranked",
    )
    cut = _cut(ranked).select(F.col("source").alias("_source"), F.col("rank").alias("cut_rank"), F.col("doc_id").alias("cut_id"))
    return stored(targets.join(cut, targets["source"].eqNullSafe(cut["_source"]), "left").drop("_source"), "plan")


def _of_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of their source's row in table."""
    t = table.withColumnRenamed("source", "_source")
    return rows.join(t, rows["source"].eqNullSafe(t["_source"]), "left").drop("_source")


def _rank() -> Column:
    """The random odds divided by the inclusion odds, squeezed into (0, 1) with their order kept; null for documents of no words and sources without a part."""
    f = F.least(F.lit(MOST_PART), F.try_divide(F.col("part"), F.col("source_size")))
    tilt = F.least(F.lit(TILT[1]), F.greatest(F.lit(TILT[0]), F.sqrt((F.col("source_size") / F.col("n")) / F.greatest(F.col("size"), F.lit(1)))))
    u = uniform(F.col("doc_id"))
    odds = (u / (1 - u)) / (f / (1 - f) * tilt)
    return F.when((F.col("part") > 0) & (F.col("size") > 0), odds / (1 + odds))


def _copies() -> Column:
    chosen = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("doc_id") <= F.col("cut_id")))
    return F.col("whole") + F.coalesce(chosen, F.lit(False)).cast("long")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole copies the mix takes), taken (words).

    A source gets its target up to half of the document at the cut. Null texts count no words, the
    null source is a source, an empty table gives an empty result; rows that repeat a doc_id share
    its random number and are taken alike; further columns are not read.
    """
    sized = stored(_sized(docs), "sizes")
    taken = _of_source(sized, source_plan(sized, weights, most)).withColumn("rank", _rank())
    return taken.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of docs, all columns of any name, each as often as the mix takes it.

    A row's copies follow from its own doc_id, source and words and its source's row of the plan, so
    rows are neither joined with each other nor moved. Cases as in mix().
    """
    plan = source_plan(stored(_sized(docs), "sizes"), weights, most)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _of_source(_sized(docs, whole), plan).withColumn("rank", _rank()).select("row", _copies().cast("int").alias("copies")).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def _cut(rows: DataFrame) -> DataFrame:
    """source, rank, doc_id of the last document taken from each source; none where not even one fits.

    A document is taken while the words before it plus half its own stay within the part.
    """
    rows = rows.withColumn("before", F.lit(0).cast("long")).withColumn("bucket", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        rows = rows.withColumn("bucket", F.floor(F.col("rank") * float(BUCKETS**level)).cast("long"))
        sums = rows.groupBy("source", "bucket", "before").agg(F.sum("size").alias("words"), F.first("part").alias("part"))
        so_far = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        # the first bucket that reaches the part, else the last one: words before it are all taken
        state = sums.withColumn("upto", F.col("before") + so_far).withColumn("last", F.max("bucket").over(W.partitionBy("source")))
        held = (
            state
            .filter((F.col("upto") >= F.col("part")) | (F.col("bucket") == F.col("last")))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        )
        held = held.select(F.col("source").alias("_source"), F.col("at.bucket").alias("_bucket"), F.col("at.before").alias("_before"))
        joined = rows.drop("before").join(held, rows["source"].eqNullSafe(held["_source"]) & (rows["bucket"] == held["_bucket"]))
        rows = stored(joined.withColumn("before", F.col("_before")).drop("_source", "_bucket", "_before"), f"cut{level}")
    order = W.partitionBy("source").orderBy("rank", "doc_id")
    ahead = F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    fits = rows.withColumn("fits", ahead + F.col("size") / 2 <= F.col("part"))
    last = fits.filter("fits").groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("at"))
    none = fits.groupBy("source").agg(F.min(F.struct("rank", "doc_id")).alias("first"))
    # where nothing in the last bucket fits, the cut lies just before its first document
    l = last.withColumnRenamed("source", "_source")
    both = none.join(l, none["source"].eqNullSafe(l["_source"]), "left")
    return both.select(
        "source",
        F.coalesce(F.col("at.rank"), F.col("first.rank")).alias("rank"),
        F.coalesce(F.col("at.doc_id"), F.col("first.doc_id") - 1).alias("doc_id"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT] AS weight, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (source_size * 3) / weight AS ratio,
    (total - coalesce(sum(source_size * 3) OVER (ORDER BY (source_size * 3) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY (source_size * 3) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), m AS (
  SELECT *, (SELECT arg_min(level, ratio) FROM l WHERE level * weight <= source_size * 3) AS final_level FROM l
), t AS (
  SELECT source, source_size, n, CASE WHEN final_level IS NULL OR final_level * weight >= source_size * 3 THEN (source_size * 3)::DOUBLE ELSE final_level * weight END AS target FROM m
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.n, t.target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole,
    (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, target - whole * source_size AS part FROM r
), q AS (
  SELECT *, CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / (least(0.999999999, part / source_size) / (1 - least(0.999999999, part / source_size)) * least(4.0, greatest(0.25, sqrt((source_size / n) / greatest(size, 1))))) END AS k FROM p
), o AS (
  SELECT *, k / (1 + k) AS rank, sum(size) OVER (PARTITION BY source ORDER BY k / (1 + k), doc_id ROWS UNBOUNDED PRECEDING) - size AS ahead FROM q WHERE k IS NOT NULL
), c AS (
  SELECT source, max(CASE WHEN ahead + size / 2 <= part THEN ahead END) AS last_ahead FROM o GROUP BY source
), x AS (
  SELECT o.doc_id FROM o JOIN c ON o.source IS NOT DISTINCT FROM c.source WHERE o.ahead <= c.last_ahead
)
SELECT q.doc_id, q.size, q.source_size, q.target, ((q.whole + (x.doc_id IS NOT NULL)::BIGINT) * q.size)::BIGINT AS taken
FROM q LEFT JOIN x ON q.doc_id = x.doc_id
"""
