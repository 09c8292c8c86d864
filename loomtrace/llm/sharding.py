"""Minimax contiguous partition of ordered atomic groups into shards.

Groups (equal texts) are ordered by the hash of their text. The smallest shard capacity for which
the greedy cut needs no more than the wanted shards is found by search over capacities; a
feasibility check jumps from cut to cut with the running sum of group sizes.

Running sums are built in two levels (sums per chunk of the hash range, then within a chunk), and a
jump reads only the chunk that its cut falls into, so the driver holds CHUNKS numbers whatever the
size of the corpus. A hot group is one row after map-side aggregation. A document's shard follows
from comparing its hash with the cuts; no join is needed.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import documents, stored

SHARDS = 8
#: Chunks of the hash range, by its first three hexadecimal digits.
CHUNKS = 4096
#: Capacities that one round of the search tries at once.
TRIED = 15
#: Groups near the cuts that the driver may fetch.
MOST_LOCAL = 50_000
#: Cells of a shard in which rows are numbered.
CELLS = 512


class _Prefix:
    """Running sums of the groups' sizes; next_cut() finds the last group that still fits."""

    def __init__(self, sized: DataFrame):
        groups = sized.groupBy("group").agg(F.sum("size").alias("bytes")).withColumn("chunk", F.conv(F.substring("group", 1, 3), 16, 10).cast("int"))
        order = W.partitionBy("chunk").orderBy("group").rowsBetween(W.unboundedPreceding, 0)
        self.groups = stored(groups.withColumn("upto", F.sum("bytes").over(order)), "groups")
        sums = {r.chunk: (r.total, r.largest) for r in self.groups.groupBy("chunk").agg(F.max("upto").alias("total"), F.max("bytes").alias("largest")).collect()}  # CHUNKS rows at most
        self.start = [0]
        for chunk in range(CHUNKS):
            self.start.append(self.start[-1] + sums.get(chunk, (0, 0))[0])
        self.total, self.largest = self.start[-1], max((x[1] for x in sums.values()), default=0)

    def next_cuts(self, limits: list[int]) -> list[int]:
        """For each limit the largest running sum within it."""
        chunk = {x: min(CHUNKS - 1, bisect.bisect_right(self.start, x) - 1) for x in limits if x < self.total}
        if not chunk:
            return [self.total for _ in limits]
        within = self.groups.filter(F.col("chunk").isin(sorted(set(chunk.values()))))
        best = (
            within
            .agg(
                *[F.max(F.when((F.col("chunk") == c) & (F.col("upto") <= x - self.start[c]), F.col("upto"))).alias(f"c{i}") for i, (x, c) in enumerate(chunk.items())],
            )
            .first()
        )
        found = {x: self.start[c] + (best[f"c{i}"] or 0) for i, (x, c) in enumerate(chunk.items())}
        return [found.get(x, self.total) for x in limits]

    def cuts(self, capacities: list[int], shards: int) -> list[list[int]]:
        """The greedy cuts under each capacity, as running sums; feasible where the last is the total."""
        reached = [[0] for _ in capacities]
        for _ in range(shards):
            for own, cut in zip(reached, self.next_cuts([min(self.total, own[-1] + c) for own, c in zip(reached, capacities, strict=True)]), strict=True):
                own.append(cut)
        return [own[1:] for own in reached]

    def between(self, spans: list[tuple[int, int]]) -> list[tuple[int, str]] | None:
        """Running sums and groups that lie in any of the spans, in order; None if they are over MOST_LOCAL."""
        wanted = F.lit(False)
        for a, b in spans:
            c, d = (max(0, bisect.bisect_left(self.start, x) - 1) for x in (a, b))  # sums end in the chunk that reaches them
            after = (F.col("chunk") > c) | ((F.col("chunk") == c) & (F.col("upto") >= a - self.start[c]))
            until = (F.col("chunk") < d) | ((F.col("chunk") == d) & (F.col("upto") <= b - self.start[d]))
            wanted = wanted | (after & until)
        rows = self.groups.filter(wanted).limit(MOST_LOCAL + 1).collect()
        return sorted((self.start[r["chunk"]] + r["upto"], r["group"]) for r in rows) if len(rows) <= MOST_LOCAL else None

    def names(self, cuts: list[int]) -> list[str]:
        """The group that ends at each of some running sums."""
        if not cuts:
            return []
        places = [(c := max(0, bisect.bisect_left(self.start, x) - 1), x - self.start[c]) for x in cuts]
        within = self.groups.filter(F.col("chunk").isin(sorted({c for c, _ in places})))
        return list(
            within
            .agg(*[F.max(F.when((F.col("chunk") == c) & (F.col("upto") == x), F.col("group"))).alias(f"g{i}") for i, (c, x) in enumerate(places)])
            .first()
        )


def minimax_cuts(sized: DataFrame, shards: int = SHARDS) -> tuple[int, list[str]]:
    """The smallest feasible capacity for rows (group, size), and the last group of each shard but the last.

    Capacities are tried some at a time. A cut moves up with the capacity, so it lies between the
    cuts under the largest infeasible and the smallest feasible capacity tried; once few groups lie
    there, they are fetched and the search ends on them. If the capacity is settled before, only the
    groups at its cuts are looked up, however many lie between them and the cuts under a smaller one.
    """
    prefix = _Prefix(sized)
    if not prefix.total:
        return 0, []
    low = max(prefix.largest, -(-prefix.total // shards))  # no capacity below is feasible
    high = -(-prefix.total // shards) + prefix.largest  # always feasible
    least, (most,) = None, prefix.cuts([high], shards)
    while True:
        step = max(1, -(-(high - low) // (TRIED + 1)))
        tried = list(range(low, high, step))
        for c, cut in zip(tried, prefix.cuts(tried, shards), strict=True):
            if cut[-1] < prefix.total:
                low, least = max(low, c + 1), max(least or cut, cut)
            elif c < high:
                high, most = c, cut
        if low == high:
            return high, prefix.names(most[: shards - 1])
        near = prefix.between(list(zip(least, most, strict=True)) if least else [(0, prefix.total)])
        if near is not None:
            break
    sums, names = [0, *(x for x, _ in near)], ["", *(g for _, g in near)]

    def greedy(capacity: int) -> list[int]:
        ends = [0]
        for _ in range(shards):
            ends.append(bisect.bisect_right(sums, sums[ends[-1]] + capacity) - 1)
        return ends[1:]

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if sums[greedy(middle)[-1]] == prefix.total else (middle + 1, high)
    return high, [names[i] for i in greedy(high)][: shards - 1]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Equal texts share a shard; null counts as empty. Fewer groups than shards leave the last shards
    empty; an empty table gives an empty result. Slots number the rows of a shard from 0; ties
    (rows that repeat a doc_id) are numbered in any order.
    """
    text = F.coalesce("text", F.lit(""))
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("group"),
        ),
        "sized",
    )
    _, ends = minimax_cuts(sized, shards)
    number = sum(((F.col("group") > F.lit(end)).cast("int") for end in ends), F.lit(0))
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")
    placed = sized.select("doc_id", "size", "text_crc32", number.alias("shard"), cell.alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))  # shards * CELLS rows at most
    offsets = counts.select("shard", "cell", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("offset"))
    slot = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id")) - 1
    return (
        placed
        .join(F.broadcast(offsets), ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + slot).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir, "doc_id", "text"))
