"""Merkle manifest of a dataset, with proofs by octopus multiproofs.

A leaf is the hash of a row's fields. The leaves of a group (a source) in their order form a tree of
threes whose top is the group's subroot; the subroots in order of their groups form a tree of threes
whose top is the root.

Leaves are dealt out by ranges of (group, order): each range, a leaf partition, holds consecutive
leaves, so a group of any size is spread over many. A partition computes the nodes that lie wholly
inside it and passes on only those whose parent doesn't: a few a level. Nodes over several
partitions are then put together, LEVELS levels a round, from these.

For proofs a partition doesn't fetch paths leaf by leaf. The ancestors of its leaves are known to be
derivable, so what its proofs lack is, level by level, the siblings of its first and last ancestor
that are no ancestors themselves: the minimal union of missing coordinates. These are fetched in one
join on coordinates. With them the partition derives each shared interior node once and expands the
proof of every leaf from there. The trees of subroots are made by the same functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import documents, stored

ARITY = 3
#: Levels that a round puts together: a task sees at most ARITY ** LEVELS nodes of a group's range.
LEVELS = 6
#: Leaves of a leaf partition, about.
PER_PARTITION = 50_000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node of a group's tree; top is the level of the tree's top.
NODE = "grp string, level int, idx long, hash string, top int"


def digest(hashes: list[str]) -> str:
    """The hash of several inputs, digests as hexadecimal text."""
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def leaf_hash(*fields: Column) -> Column:
    """The hash of a row's fields: each `-` if null, else UTF-8 byte count, `:`, value."""
    parts = [F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")) for x in fields]
    return F.sha2(F.concat(*[F.coalesce(x, F.lit("-")) for x in parts]), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def widths(n: int) -> list[int]:
    """Nodes of each level, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def parents(level: list[str]) -> list[str]:
    """The next level of nodes that begin at a multiple of ARITY."""
    return [digest(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]


def inside(first: int, hashes: list[str], n: int) -> list[tuple[int, int, str]]:
    """Of a range of leaves of a tree of n leaves: the nodes wholly inside it whose parent is not, as (level, index, hash)."""
    out, level, count = [], 0, n
    while hashes:
        last = first + len(hashes)
        lo = -(-first // ARITY)  # the first parent wholly inside, and the one behind the last
        hi = -(-last // ARITY) if last == count else last // ARITY
        if count == 1 or lo >= hi:
            out += [(level, first + k, h) for k, h in enumerate(hashes)]
            break
        a, b = lo * ARITY, min(hi * ARITY, count)
        out += [(level, k, hashes[k - first]) for k in [*range(first, a), *range(b, last)]]
        hashes = parents(hashes[a - first : b - first])
        first, level, count = lo, level + 1, -(-count // ARITY)
    return out


def missing(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) that the proofs of leaves first to last (inclusive) need besides what those leaves derive."""
    out = []
    for level, count in enumerate(widths(n)[:-1]):
        out += [(level, k) for k in range(first - first % ARITY, first)]
        out += [(level, k) for k in range(last + 1, min(last - last % ARITY + ARITY, count))]
        first, last = first // ARITY, last // ARITY
    return out


def derive(first: int, hashes: list[str], n: int, fetched: dict[tuple[int, int], str]) -> list[tuple[int, list[str]]]:
    """Per level but the top: index of the first node known and the nodes known, siblings of all ancestors included. The last entry is the top."""
    out = []
    for level, count in enumerate(widths(n)):
        if count == 1:
            out.append((0, hashes))
            break
        last = first + len(hashes)
        left = [fetched[level, k] for k in range(first - first % ARITY, first)]
        right = [fetched[level, k] for k in range(last, min(-(-last // ARITY) * ARITY, count))]
        known = left + hashes + right
        first -= first % ARITY
        out.append((first, known))
        first, hashes = first // ARITY, parents(known)
    return out


def proof(idx: int, levels: list[tuple[int, list[str]]]) -> list[tuple[list[str], list[str]]]:
    """Per level the siblings left and right of a leaf's ancestor."""
    out = []
    for first, known in levels[:-1]:
        at, low = idx - first, idx - idx % ARITY - first
        out.append((known[low:at], known[at + 1 : low + ARITY]))
        idx //= ARITY
    return out


def fold(leaf: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest([*left, leaf, *right])
    return leaf


def write_path(path: list[tuple[list[str], list[str]]]) -> str:
    """Levels from the leaf up, joined by ;, each `left|right` with siblings joined by commas."""
    return ";".join(f"{','.join(left)}|{','.join(right)}" for left, right in path)


def read_path(text: str) -> list[tuple[list[str], list[str]]]:
    return [tuple([h for h in side.split(",") if h] for side in step.split("|")) for step in text.split(";")] if text else []


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves (grp, order, hash and others), dealt out, with part and seq, their order in it; and the runs: part, grp, before, count, n.

    Partitions are ranges of (grp, order, hash) with null orders first; rows equal in all of them are
    told apart by where they were read, so that no key fills a partition. A run is the part of a
    group that lies in a partition: before is the number of its leaves in partitions before. There
    are no more runs than groups and partitions together.
    """
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves.count() // PER_PARTITION + 1)
    keys = [F.col("grp"), F.col("order").asc_nulls_first(), F.col("hash"), F.col("_tie")]
    ranged = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}).drop("_tie", "order")
    rows = stored(ranged, "leaves")
    runs = rows.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("count"))
    whole = W.partitionBy("grp")
    before = F.sum("count").over(whole.orderBy("part")) - F.col("count")
    return rows, stored(runs.withColumns({"before": before, "n": F.sum("count").over(whole)}), "runs")


def in_order(rows: pd.DataFrame, runs: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, int, int]]:
    """For each run of a leaf partition: its leaves in order, the leaves of its group before, the group's size."""
    rows = rows.sort_values("seq")
    sizes = {g: (int(b), int(n)) for g, b, n in zip(runs["grp"], runs["before"], runs["n"], strict=True)}
    for grp, run in rows.groupby("grp", sort=False):
        yield run, *sizes[grp]


def _inside(rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    out = []
    for run, before, n in in_order(rows, runs):
        grp, top = run["grp"].iloc[0], height(n)
        out += [(grp, level, k, h, top) for level, k, h in inside(before, list(run["hash"]), n)]
    return pd.DataFrame(out, columns=["grp", "level", "idx", "hash", "top"])


def _upwards(base: int):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        """Nodes above those given (levels base to base + LEVELS - 1), of one range of one group."""
        grp, top = nodes["grp"].iloc[0], int(nodes["top"].iloc[0])
        given: dict[int, dict[int, str]] = {}
        for level, k, h in zip(nodes["level"], nodes["idx"], nodes["hash"], strict=True):
            given.setdefault(int(level), {})[int(k)] = h
        out, made = [], {}
        for level in range(base, min(base + LEVELS, top)):
            known = made | given.get(level, {})
            runs: dict[int, list[str]] = {}
            for k in sorted(known):
                runs.setdefault(k // ARITY, []).append(known[k])
            made = {k: digest(hashes) for k, hashes in runs.items()}
            out += [(grp, level + 1, k, h, top) for k, h in made.items()]
        return pd.DataFrame(out, columns=["grp", "level", "idx", "hash", "top"])

    return run


def nodes_between(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """All nodes that a leaf partition may lack, tops included (NODE): those that lie inside a partition with a parent that doesn't, and all that don't."""
    most = height(runs.agg(F.max("n")).first()[0] or 0)
    covers = stored(rows.select("part", "seq", "grp", "hash").groupBy("part").cogroup(runs.groupBy("part")).applyInPandas(_inside, NODE), "covers")
    made, found = None, covers
    for base in range(0, most, LEVELS):
        known = covers.filter(F.col("level").between(base, base + LEVELS - 1))
        if made is not None:
            known = known.unionByName(made.filter(F.col("level") == base))
        block = F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), F.lit(base + LEVELS) - F.col("level")))
        made = stored(known.filter("level < top").groupBy("grp", block.alias("block")).applyInPandas(_upwards(base), NODE), "nodes")
        found = found.unionByName(made)
    return found


def _wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for runs in batches:
        out = []
        for part, grp, before, count, n in zip(*(runs[c] for c in ("part", "grp", "before", "count", "n")), strict=True):
            out += [(part, grp, level, k) for level, k in missing(before, before + count - 1, n)]
        yield pd.DataFrame(out, columns=["part", "grp", "level", "idx"])


def _expand(with_proofs: bool):
    def run(rows: pd.DataFrame, context: pd.DataFrame) -> pd.DataFrame:
        runs, rest = context[context["level"] == -1], context[context["level"] >= 0]
        fetched: dict[str, dict[tuple[int, int], str]] = {}
        for grp, level, k, h in zip(rest["grp"], rest["level"], rest["idx"], rest["hash"], strict=True):
            fetched.setdefault(grp, {})[int(level), int(k)] = h
        above = dict(zip(runs["grp"], zip(runs["path"], runs["root"], strict=True), strict=True))
        out = []
        for run, before, n in in_order(rows, runs):
            grp = run["grp"].iloc[0]
            levels = derive(before, list(run["hash"]), n, fetched.get(grp, {}))
            rest_of_path, root = read_path(above[grp][0] or ""), above[grp][1]
            subroot, root = levels[-1][1][0], root or levels[-1][1][0]
            upper, upper_of = [], None
            for k, (key, leaf, tampered) in enumerate(zip(run["row_key"], run["hash"], run["tampered"], strict=True), before):
                if upper_of != k // ARITY:  # shared by the siblings
                    upper, upper_of = proof(k // ARITY, levels[1:]) + rest_of_path if len(levels) > 1 else rest_of_path, k // ARITY
                path = proof(k, levels[:2]) + upper
                folded = fold(leaf if tampered is None else tampered, path)
                siblings = digest([h for left, right in path for h in left + right])
                out.append((key, leaf, subroot, root, siblings, folded, folded == root, write_path(path) if with_proofs else None))
        return pd.DataFrame(out, columns=["row_key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"])

    return run


PROOFS = "row_key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof string"


PROVEN = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")


def prove(above: DataFrame | None, rows: DataFrame, runs: DataFrame, nodes: DataFrame, with_proofs: bool) -> DataFrame:
    """PROOFS for every leaf; above has grp, path and root of what lies over the groups' trees (None: nothing does)."""
    wanted = runs.mapInPandas(_wanted, "part int, grp string, level int, idx long")
    fetched = wanted.join(nodes, ["grp", "level", "idx"]).select("part", "grp", "level", "idx", "hash")
    if above is None:
        runs = runs.withColumns({"path": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})
    else:
        runs = runs.join(above, "grp")
    context = runs.withColumn("level", F.lit(-1)).unionByName(fetched, allowMissingColumns=True)
    return rows.groupBy("part").cogroup(context.groupBy("part")).applyInPandas(_expand(with_proofs), PROOFS)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", tampered: Column | None = None, with_proofs: bool = False) -> DataFrame:
    """order, leaf, subroot, root, proof_sha256, folded_root, verified and proof (null unless with_proofs) for every row of docs.

    tampered is the leaf hash of a row as found, null where nothing was touched: folded_root is what
    it and the original siblings give, and verified says whether that is the root. group is a string.
    Null groups are a group of their own, the first; null orders come first in their group, rows of
    one order follow each other by leaf. Repeated rows are leaves of their own. Null and empty texts
    differ. An empty table gives an empty result; columns beside fields are not read.
    """
    grp = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group)))
    leaves = docs.select(
        F.col(order).cast("string").alias("row_key"), grp.alias("grp"), F.col(order).alias("order"),
        leaf_hash(*map(F.col, fields)).alias("hash"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"),
    )
    rows, runs = placed(leaves)
    nodes = nodes_between(rows, runs)
    tops = nodes.filter(F.col("level") == F.col("top"))
    tops = tops.select(F.col("grp").alias("row_key"), F.lit("").alias("grp"), F.col("grp").alias("order"), "hash", F.lit(None).cast("string").alias("tampered"))
    top_rows, top_runs = placed(tops)
    over = prove(None, top_rows, top_runs, nodes_between(top_rows, top_runs), True)
    over = stored(over.select(F.col("row_key").alias("grp"), F.col("proof").alias("path"), "root"), "over")
    return prove(over, rows, runs, nodes, with_proofs).select(F.col("row_key").cast(docs.schema[order].dataType).alias(order), *PROVEN)


def without_newlines(docs: DataFrame) -> Column:
    """The leaf of a row whose text lost its newlines, where 2 divides the crc32 of its doc_id; null elsewhere."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    fields = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    return F.when(touched, leaf_hash(*fields))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *FIELDS)
    return manifest(docs, tampered=without_newlines(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_leaf(text: str) -> str:
    sized = "coalesce(strlen(({0})::VARCHAR)::VARCHAR || ':' || ({0})::VARCHAR, '-')"
    return "sha256(" + " || ".join(sized.format(text if c == "text" else c) for c in FIELDS) + ")"


#: One level up: every three nodes of a tree become one while more than one is left.
_SQL_UP = "SELECT grp, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY grp, level, n, idx // 3"
#: One level up on a leaf's path: its hash so far among its original siblings.
_SQL_FOLD = """SELECT f.grp, f.leaf, f.level + 1, f.idx // 3, (any_value(f.n) + 2) // 3,
    sha256(string_agg(CASE WHEN t.idx = f.idx THEN f.hash ELSE t.hash END, '' ORDER BY t.idx))
  FROM {0} f JOIN {1} t ON t.grp = f.grp AND t.level = f.level AND t.idx // 3 = f.idx // 3 WHERE f.n > 1 GROUP BY f.grp, f.leaf, f.level, f.idx"""

OP13_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
  SELECT *, {_sql_leaf("text")} AS hash, {_sql_leaf("replace(text, chr(10), '')")} AS other,
    list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])) AS c,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n
  FROM documents, crc
), leaves AS (SELECT *, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN other ELSE hash END AS found FROM d
), tree AS (SELECT grp, 0 AS level, idx, n, hash FROM leaves UNION ALL {_SQL_UP.format("tree")}
), tops AS (SELECT grp, hash AS subroot FROM tree WHERE n = 1
), over_tops AS (SELECT 0 AS grp, 0 AS level, grp AS idx, (SELECT count(*) FROM tops) AS n, subroot AS hash FROM tops UNION ALL {_SQL_UP.format("over_tops")}
), fold AS (SELECT grp, doc_id AS leaf, 0 AS level, idx, n, found AS hash FROM leaves UNION ALL {_SQL_FOLD.format("fold", "tree")}
), fold_tops AS (
  SELECT 0 AS grp, leaf, 0 AS level, grp AS idx, (SELECT count(*) FROM tops) AS n, hash FROM fold WHERE n = 1 UNION ALL {_SQL_FOLD.format("fold_tops", "over_tops")}
), powers AS (SELECT range AS level, (3 ** range)::BIGINT AS p FROM range(30)
), siblings AS (
  SELECT l.doc_id, 0 AS part, t.level, t.idx, t.hash FROM leaves l, powers p JOIN tree t ON t.level = p.level
  WHERE t.grp = l.grp AND t.n > 1 AND t.idx // 3 = l.idx // p // 3 AND t.idx <> l.idx // p
  UNION ALL
  SELECT l.doc_id, 1, t.level, t.idx, t.hash FROM leaves l, powers p JOIN over_tops t ON t.level = p.level
  WHERE t.n > 1 AND t.idx // 3 = l.grp // p // 3 AND t.idx <> l.grp // p
), proofs AS (SELECT doc_id, sha256(string_agg(hash, '' ORDER BY part, level, idx)) AS proof_sha256 FROM siblings GROUP BY doc_id
)
SELECT l.doc_id, l.hash AS leaf, subroot, r.hash AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = r.hash AS verified
FROM leaves l JOIN tops USING (grp) JOIN fold_tops f ON f.leaf = l.doc_id AND f.n = 1 JOIN over_tops r ON r.n = 1 LEFT JOIN proofs USING (doc_id)
"""
