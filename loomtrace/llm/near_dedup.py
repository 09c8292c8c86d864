"""Near-duplicate detection with circulant MinHash, banding and exact Jaccard verification.

Two permutations of a 2^32 universe make every signature coordinate: shingles go through the first,
and coordinate k is the least image of the shingles, circularly shifted by k, under the second.
Bands of coordinates are hashed; documents that share a band hash are candidates.

Documents with equal shingle sets are one node (their least id). Candidates of a bucket are first
compared with the bucket's least node only (a star, one row per member), which joins nearly all
copies. Members that stay outside their bucket's main component are compared with a few of its
members per bucket. What is then still apart within a bucket is compared completely, in bounded
blocks. So no link that would join two components is lost, and
large groups of copies don't make all pairs. Every link is confirmed on the whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import discard, documents, join_heavy, numbered, slices, spread, stored

SHINGLE = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
#: At a similarity of 0.75 two documents share no band with a probability of (1 - 0.75 ** ROWS) ** BANDS = 5e-6.
BANDS, ROWS = 32, 4
#: Members of a main component that a member outside is compared with, per bucket, before the rest.
TRIES = 3
#: Shingles of members, and of askers, of a family that one task compares (one text at least).
BLOCK = 4_000_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than SHINGLE make one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * _MULTIPLY
            out ^= out >> np.uint64(29)
        out *= _SPREAD
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _first_permutation(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _second_permutation(x: np.ndarray) -> np.ndarray:
    """In place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate k is min over shingles of second(first(shingle) + k)."""
    base = _first_permutation(hashes.astype(np.uint32))
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, np.uint32(0xFFFFFFFF))
    for i in range(0, len(base), 1024):  # stays in the processor's cache
        np.minimum(least, _second_permutation(base[None, i : i + 1024] + shifts).min(axis=1), out=least)
    return least


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash per band; the band's number is part of it."""
    return np.array([xxhash.xxh3_64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) for b in range(BANDS)], np.uint64).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in slices(whole)):
        n, keys, bands = [], [], []
        for x in batch.column(1).to_pylist():
            s = shingles(x)
            n.append(len(s))
            keys.append(hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None)
            bands.append(band_hashes(signature(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n", "set_key", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in slices(whole)):
        sets = [shingles(x).view(np.int64) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])


def _possible(a: Column, b: Column) -> Column:
    """Set sizes alone don't rule a link out."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity and whether they are linked, for distinct pairs (a, b), on whole shingle sets."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("_sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("_sb")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("i"), F.size("_sa").alias("na"), F.size("_sb").alias("nb"))
    union = F.col("na") + F.col("nb") - F.col("i")
    return counted.select("a", "b", (F.col("i") / union).alias("similarity"), (100 * F.col("i") >= PERCENT * union).alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """id, component (least id reachable) for the ends of edges (a, b), by alternating large and small stars.

    Every round rewires edges towards smaller ids and writes them to the shared folder; it ends when
    no edge changes. The driver sees two numbers a round.
    """
    edges = stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        fresh = stored(small, "edges")
        discard(edges)
        edges = fresh
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return (
        edges
        .select(F.col("u").alias("id"), F.col("v").alias("component"))
        .unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    )


def _cross_links(rows: pd.DataFrame) -> pd.DataFrame:
    """a, b: for each asking row its links into other components, one per component, by an inverted index of the block's shingles."""
    members, asking = rows[~rows["asks"]], rows[rows["asks"]]
    if members.empty or asking.empty:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    sizes = members["set"].map(len).to_numpy()
    hashes = np.concatenate(members["set"].to_list())
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], np.repeat(np.arange(len(members)), sizes)[order]
    ids, component = members["id"].to_numpy(), members["component"].to_numpy()
    found = []
    for i, c, s in zip(asking["id"], asking["component"], asking["set"], strict=True):
        lo, hi = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owners[at], minlength=len(members))
        hit = np.flatnonzero((100 * common >= PERCENT * (len(s) + sizes - common)) & (component != c))
        found += [(i, ids[hit[k]]) for k in np.unique(component[hit], return_index=True)[1]]
    return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)


def family_links(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between components that meet in a bucket, on whole shingle sets.

    mixed has (bucket, id, component). Buckets that share a member make a family. Every member outside
    of its family's largest component is compared with all of the family, in blocks of members by
    blocks of askers, of BLOCK shingles each, so that no task holds a whole family of whatever texts;
    sets travel once per block, not per pair.
    """
    centre = mixed.groupBy("bucket").agg(F.min("id").alias("a"))
    family = components(mixed.join(centre, "bucket").select("a", F.col("id").alias("b")).filter("a <> b")).withColumnRenamed("component", "family")
    sized = sets.select("id", F.size("set").alias("shingles"))
    members = stored(mixed.select("id", "component").distinct().join(family, "id").join(sized, "id"), "family")
    counts = members.groupBy("family", "component").agg(F.sum("shingles").alias("n"))
    shape = (
        counts
        .groupBy("family")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("largest"))
    )
    shape = shape.select(
        "family",
        "main",
        F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("largest")) / BLOCK).cast("int").alias("asking_blocks"),
    )
    with_sets = members.drop("shingles").join(shape, "family").join(sets, "id")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = with_sets.select(
        "family",
        "id",
        "component",
        "set",
        F.lit(False).alias("asks"),
        own("blocks").alias("i"),
        every("asking_blocks").alias("j"),
    )
    asks = (
        with_sets
        .filter("component <> main")
        .select("family", "id", "component", "set", F.lit(True).alias("asks"), every("blocks").alias("i"), own("asking_blocks").alias("j"))
    )
    return asked.unionByName(asks).groupBy("family", "i", "j").applyInPandas(_cross_links, "a long, b long")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    kept marks the least id of a component. Null and empty texts, and texts of white space alone,
    have empty sets and stand alone. Rows that repeat an id and text count as one document. Ids should
    be distinct and not null (drop_near() numbers its rows where they are not): a row with a null id
    joins rows of equal sets and else has a null component and is kept. An empty table gives an empty
    result; further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(spread(rows).mapInArrow(_signatures, "doc_id long, n long, set_key binary, bands array<long>"), "signatures")
    nodes = stored(
        signed.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")),
        "nodes",
    )
    # buckets of two nodes or more
    members = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = stored(members.groupBy("bucket").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared")
    bucketed = stored(join_heavy(members, shared, ["bucket"], "m", "inner").drop("m"), "buckets")
    sizes = bucketed.select("id", "n").distinct()
    involved = sizes.select(F.col("id").alias("doc_id"))
    sets = stored(rows.join(involved, "doc_id", "left_semi").mapInArrow(_sets, "id long, set array<long>").dropDuplicates(["id"]), "sets")

    def tested(pairs: DataFrame, name: str) -> DataFrame:
        return stored(verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets), name)

    # first: every member with its bucket's least node
    star = bucketed.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"), "n").distinct()
    star = star.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("_n")), "a").filter(_possible(F.col("n"), F.col("_n")))
    first = tested(star, "first")
    found = stored(components(first.filter("linked")), "components")

    def joined(found: DataFrame, links: DataFrame) -> DataFrame:
        """Edges of components found so far, as stars, and of new links: fewer rounds than from all links."""
        return found.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(links.select("a", "b"))

    def placed(found: DataFrame) -> DataFrame:
        """Buckets' members with their components, of buckets that hold two components or more."""
        c = bucketed.join(found, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
        mixed = c.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        return stored(c.join(mixed.select("bucket"), "bucket", "left_semi"), "mixed")

    # second: members outside of the bucket's main component with some of its members
    mixed = placed(found)
    by = (
        mixed
        .groupBy("bucket", "component")
        .agg(F.count(F.lit(1)).alias("m"), *[F.min_by("id", F.xxhash64("id", "bucket", F.lit(t))).alias(f"t{t}") for t in range(TRIES)])
    )
    main = (
        by
        .groupBy("bucket")
        .agg(F.max_by(F.struct("component", *[f"t{t}" for t in range(TRIES)]), F.struct("m", "component")).alias("main"))
        .filter("main is not null")
    )
    some = (
        mixed
        .join(main, "bucket")
        .filter("component <> main.component")
        .select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array(*[f"main.t{t}" for t in range(TRIES)]))).alias("b"))
    )
    second = tested(some, "second")
    found = stored(components(joined(found, second.filter("linked"))), "components")

    # third: all that is still apart in a bucket
    apart = placed(found)
    third = stored(family_links(apart, sets), "third")
    found = stored(components(joined(found, third)), "components")
    discard(bucketed, sets, first, second, third, mixed, apart, shared)

    placed_nodes = nodes.join(found, "id", "left").select("set_key", "copies", F.coalesce("component", "id").alias("component"))
    own = F.coalesce("component", "doc_id")
    return (
        join_heavy(signed.select("doc_id", "n", "set_key"), stored(placed_nodes, "placed"), ["set_key"], "copies")
        .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
    )


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one document of each component (its least id); cases as in link().

    Texts that are null, empty or of white space alone all stay. Rows that repeat a kept id and text
    all stay, but where some id is null or comes with several texts: then rows are linked by their
    number in order of id (null last) and text, and one row of a component stays.
    """
    by_id = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.xxhash64("text")).alias("_a"), F.max(F.xxhash64("text")).alias("_b"))
    if by_id.filter("_id is null or _a <> _b").isEmpty():
        dropped = link(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped"))
        return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")
    whole = docs.select(F.struct("*").alias("row"))
    rows = numbered(whole, F.col("row.doc_id").asc_nulls_last(), F.xxhash64("row.text"))
    dropped = link(rows.select(F.col("place").alias("doc_id"), F.col("row.text").alias("text"))).filter(~F.col("kept"))
    return rows.join(dropped.select(F.col("doc_id").alias("place")), "place", "left_anti").select("row.*")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir, "doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM d
), k AS (
  SELECT doc_id, len(sh)::BIGINT AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) ELSE 'empty' || doc_id END AS key, sh FROM s
), r AS (
  SELECT key, min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh FROM k GROUP BY key
), u AS (
  SELECT rep, n, unnest(sh) AS g FROM r
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), c(id, root) AS (
  SELECT rep, rep FROM r UNION SELECT e.b, c.root FROM c JOIN e ON c.id = e.a WHERE c.root < e.b
), m AS (
  SELECT id, min(root) AS root FROM c GROUP BY id
)
SELECT k.doc_id, k.n AS n_shingles, m.root AS component_id, k.doc_id = m.root AS kept FROM k JOIN r USING (key) JOIN m ON m.id = r.rep
"""
