"""Document fingerprints by one-permutation MinHash, with Spark functions alone.

Each five-word shingle (words of the lower-cased text; fewer words make one shingle) is hashed once.
The leading bits of a hash choose one of BINS bins, and a bin keeps its least hash. An empty bin
takes the value of another: it tries the bins of its own fixed pseudo-random sequence and takes the
first that is not empty (optimal densification); if the first PROBES are all empty, the bin goes on
over all that are filled, in an order of its own by hash, so every bin gets a value. Of each value the
low-order BITS bits are stored, eight bins to a long.

Equal bins of unrelated texts agree by chance once in 2 ** BITS; likeness() takes that share out.
The fingerprint of a text depends on the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import documents, numbered
from loomtrace.llm.quality import let

SHINGLE = 5
BINS, BITS = 256, 8
#: Bins that an empty one tries before it looks at all that are filled.
PROBES = 12
#: Consecutive documents that meet in one window; a document more comes along from the next block.
BLOCK = 256

_SHIFT = 64 - (BINS - 1).bit_length()
#: Longs of a packed fingerprint, and the lowest bit of each bin in one.
_LONGS, _PER_LONG = BINS * BITS // 64, 64 // BITS
_LOWEST = sum(1 << (BITS * k) for k in range(_PER_LONG))


def probe_sequence(i: int) -> list[int]:
    """The bins that bin i tries first, from a fixed 64-bit mixing rule."""
    out, state = [], i
    for _ in range(PROBES):
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        mixed = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        state = (mixed ^ (mixed >> 27)) * 0x94D049BB133111EB % 2**64
        out.append((state >> 31) % BINS)
    return out


def _shingle_hashes(text: Column) -> Column:
    """Hashes of a text's shingles, repeats included; null for a text without words."""

    def windows(ws: Column) -> Column:
        # a window that runs over the end hashes fewer words: those are cut off behind
        hashes = F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, SHINGLE)]))
        return F.slice(hashes, F.lit(1), F.greatest(F.size(ws) - (SHINGLE - 1), F.lit(1)))

    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return let(trimmed, lambda t: F.when(F.length(t) > 0, let(F.split(t, r"[\x20\x09-\x0D]+"), windows)))


def _minima(hashes: Column) -> Column:
    """The least hash of each filled bin, in order of bins (as signed numbers)."""

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: ~F.shiftrightunsigned(x.bitwiseXOR(F.get(s, i - 1)), _SHIFT).eqNullSafe(F.lit(0)))

    return let(F.sort_array(hashes), firsts)


def _densified(minima: Column) -> Column:
    """A value for each of the BINS bins."""
    ids = F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))
    tries = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.array(*map(F.lit, probe_sequence(i))).alias("to")) for i in range(BINS)])

    def fill(full: Column, m: Column) -> Column:
        def nearest(i: Column) -> Column:
            ranked = F.transform(m, lambda x: F.struct(F.xxhash64(i, F.shiftrightunsigned(x, _SHIFT)).alias("rank"), x.alias("x")))
            return F.array_min(ranked)["x"]

        return F.zip_with(
            full,
            tries,
            lambda v, t: F.coalesce(v, *[F.get(full, F.get(t["to"], F.lit(j))) for j in range(PROBES)], nearest(t["i"])),
        )

    def spread_out(m: Column) -> Column:
        placed = let(
            F.transform(m, lambda x: F.shiftrightunsigned(x, _SHIFT)),
            lambda b: F.transform(ids, lambda i: F.get(m, F.array_position(b, i).cast("int") - 1)),
        )
        return let(placed, lambda full: fill(full, m))

    return let(minima, spread_out)


def _packed(values: Column) -> Column:
    def one(g: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(_PER_LONG):
            out = out.bitwiseOR(F.shiftleft(F.get(values, g * _PER_LONG + k).bitwiseAND(F.lit(2**BITS - 1)), BITS * k))
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(_LONGS - 1)), one)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text, an array of longs; null for a text without words, or null."""
    return let(_shingle_hashes(text), lambda h: F.when(h.isNotNull(), let(_densified(_minima(h)), _packed)))


def as_text(packed: Column) -> Column:
    """A packed fingerprint as hexadecimal digits, '' for null."""
    digits = F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.when(packed.isNull(), F.lit("")).otherwise(digits)


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles of two packed fingerprints, 0 to 1; 1 for two texts without words, 0 for one."""

    def equal_bins(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.lit(_PER_LONG) - F.bit_count(z.bitwiseAND(F.lit(_LOWEST)))

    equal = F.aggregate(F.zip_with(a, b, equal_bins), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    near = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(near)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, packed of every row, and next_text, next_packed of the row behind it by ascending doc_id (of the first behind the last).

    Null ids come first; rows of one id follow each other by a hash of their texts. Rows are numbered
    by range partitions and meet in blocks of consecutive numbers; the first row of a block also goes
    to the block before.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = numbered(rows, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    n = rows.count()
    rows = rows.withColumn("packed", fingerprint(F.col("text")))
    at = lambda place, order: F.struct(F.floor(place / BLOCK).alias("block"), order.alias("order"))
    own, guest = at(F.col("place"), F.col("place")), at(F.pmod(F.col("place") - 1, F.lit(n)), F.when(F.col("place") == 0, F.lit(n)).otherwise(F.col("place")))
    goes = F.when(F.col("place") % BLOCK == 0, F.array(own, guest)).otherwise(F.array(own))
    met = rows.withColumn("_to", F.explode(goes)).withColumns({"block": F.col("_to.block"), "order": F.col("_to.order")})
    w = W.partitionBy("block").orderBy("order")
    met = met.withColumns({"next_text": F.lead("text").over(w), "next_packed": F.lead("packed").over(w)})
    return met.filter((F.col("order") == F.col("place")) & (F.floor(F.col("place") / BLOCK) == F.col("block"))).drop("_to", "block", "order", "place")


def edited(text: Column, by: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many of by, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(by, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    Null texts are empty. Texts without words have the fingerprint '', like each other by 1.0 and
    nothing else (0.0). Repeated rows follow each other. A single row is its own next. An empty table
    gives an empty result; further columns are not read.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_packed", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir, "doc_id", "text"))
