"""Exact dedup with counting quotient filters.

Each partition builds counting quotient filters of its texts' fingerprints, one per range of
quotients. Filters of a range merge losslessly: their sorted remainders are merged and counts of
equal fingerprints added. Only fingerprints with a count above one route their texts to the byte
verification, which groups by the whole normalised text.

A group of copies collapses to one slot per partition in the filters and to one row per task in
the byte verification (map-side aggregation), so no task ever holds a hot group. Rows of hot groups
are dealt out and find their group by broadcast, as there are few such groups by definition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import ascii_lower, documents, join_heavy, semi_heavy, slices, stored

#: Most leading bits of a fingerprint that choose the range (block) it is merged in.
MAX_BLOCK_BITS = 16
#: Fingerprints that one merge task should hold.
PER_BLOCK = 1 << 20

NARROW = "doc_id long, fp long, sha binary"


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case (bytes.lower touches ASCII only); null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _digests(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole)):
            norm = [normalise(x) for x in batch.column(1).to_pylist()]
            sha = [hashlib.sha256(x).digest() for x in norm]
            fp = np.frombuffer(b"".join(x[:8] for x in sha), dtype="<i8") if sha else np.zeros(0, "<i8")
            columns = [batch.column(0), pa.array(fp), pa.array(sha, pa.binary())]
            names = ["doc_id", "fp", "sha"]
            if with_text:
                columns, names = [*columns, pa.array(norm, pa.binary())], [*names, "norm"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_filter(keys: np.ndarray, counts: np.ndarray, key_bits: int) -> bytes:
    """A counting quotient filter of sorted distinct keys of key_bits bits.

    Layout: slot count and quotient bits; an occupied bit per quotient; a run-end bit per slot; the
    remainders in slot order; their counts. About one slot per quotient.
    """
    bits = min(key_bits - 1, max(3, int(np.ceil(np.log2(len(keys) + 1)))))
    shift = np.uint64(key_bits - bits)
    quotient = (keys >> shift).astype(np.int64)
    remainder = keys & ((np.uint64(1) << shift) - np.uint64(1))
    occupied = np.zeros(1 << bits, bool)
    occupied[quotient] = True
    run_end = np.append(quotient[1:] != quotient[:-1], True) if len(keys) else np.zeros(0, bool)
    return b"".join(x.tobytes() for x in (np.array([len(keys), bits], "<u8"), np.packbits(occupied), np.packbits(run_end), remainder.astype("<u8"), counts.astype("<u8")))


def decode_filter(data: bytes, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of an encoded filter."""
    n, bits = (int(x) for x in np.frombuffer(data, "<u8", 2))
    at = 16
    occupied = np.unpackbits(np.frombuffer(data, np.uint8, (1 << bits) // 8, at)).astype(bool)
    at += (1 << bits) // 8
    run_end = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at))[:n].astype(np.int64)
    at += (n + 7) // 8
    remainder, counts = np.frombuffer(data[at : at + 8 * n], "<u8"), np.frombuffer(data[at + 8 * n : at + 16 * n], "<u8")
    run = np.cumsum(run_end) - run_end  # the run of each slot
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    return (quotient << np.uint64(key_bits - bits)) | remainder, counts


def merge_filters(filters: list[bytes], key_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and added counts of several filters; the stable sort merges their sorted runs."""
    parts = [decode_filter(x, key_bits) for x in filters]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _partition_filters(block_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    key_bits = 64 - block_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        fps, counts = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
        blocks = (fps >> np.uint64(key_bits)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])[: len(blocks)]), len(blocks))
        keys = fps & np.uint64((1 << key_bits) - 1)
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(blocks[s])], pa.int64()), pa.array([encode_filter(keys[s:e], counts[s:e], key_bits)], pa.binary())],
                ["block", "filter"],
            )

    return run


def _repeated(block_bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merge_filters(list(block["filter"]), 64 - block_bits)
        top = np.uint64(block["block"].iloc[0]) << np.uint64(64 - block_bits)
        more = counts > 1
        return pd.DataFrame({"fp": (keys[more] | top).view(np.int64), "n": counts[more].astype(np.int64)})

    return run


def repeated_fingerprints(narrow: DataFrame) -> DataFrame:
    """Distinct `fp` that occur more than once in `narrow`, and how often (`n`), by merged counting quotient filters."""
    n = narrow.count()
    bits = min(MAX_BLOCK_BITS, max(6, int(np.ceil(np.log2(n / PER_BLOCK + 1)))))
    filters = narrow.select("fp").mapInArrow(_partition_filters(bits), "block long, filter binary")
    return filters.groupBy("block").applyInPandas(_repeated(bits), "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (normalised text).

    Of equal normalised texts the largest id stays. Null and empty texts form one group. Ids should
    be distinct; rows that repeat an id and text are copies of each other and all marked kept. An
    empty table gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    narrow = stored(rows.mapInArrow(_digests(False), NARROW), "digests")
    repeated = stored(repeated_fingerprints(narrow), "repeated")
    routed = semi_heavy(rows.mapInArrow(_digests(True), f"{NARROW}, norm binary"), repeated, "fp", "n", "doc_id")
    groups = (
        routed
        .groupBy("fp", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"), F.first("sha").alias("sha"))
        .select("fp", "sha", "keep_id", "size")
    )
    keep_id = F.coalesce("keep_id", "doc_id")
    return join_heavy(narrow, stored(groups, "groups"), ["fp", "sha"], "size").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without texts that equal one of a larger doc_id; cases as in exact_groups().

    Rows are told apart by id and normalised text, so that an id may come with several texts. Of null
    and empty texts the one with the largest id stays; rows that repeat a kept id and text all stay. A
    null id is smaller than all others.
    """
    dropped = exact_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped"), F.col("text_sha256").alias("_sha")).distinct()
    same = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256) == dropped["_sha"]
    return docs.join(dropped, docs["doc_id"].cast("long").eqNullSafe(dropped["_dropped"]) & same, "left_anti")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir, "doc_id", "text"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
