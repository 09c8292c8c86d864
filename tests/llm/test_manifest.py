"""The Merkle manifest against trees built in plain Python, and multiproofs against whole trees."""

import hashlib
import random
import zlib

import pytest

from loomtrace.llm import manifest as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in groups[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            at, siblings = leaf((*r[:4], r[4].replace("\n", "")) if touched else r), []
            for levels, j in ((trees[k], i), (top, g)):
                for level in levels[:-1]:
                    low = j - j % 3
                    left, right = level[low:j], level[j + 1 : low + 3]
                    siblings += left + right
                    at, j = h(*left, at, *right), j // 3
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*siblings), at, at == top[-1][0]))
    return sorted(out, key=repr)


def proven(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in m.manifest(docs, tampered=m.without_newlines(docs)).drop("proof").collect()), key=repr)


def test_manifest_equals_brute_force(spark):
    big = 1 << 60  # ids that a double doesn't hold
    rows = [(big + i, "a", "x", None, f"t{i}\n") for i in range(300)] + [(i, f"s{i % 40}", None, i, "é\n🎉" * (i % 3)) for i in range(200)]
    rows += [(None, "a", "x", 1, "q")] * 3 + [(5, None, None, None, None), (7, "", "y", 0, ""), (7, "", "y", 0, ""), (8, "é", "y", 0, "\n")]
    assert proven(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10])
def test_small_and_empty_tables(spark, n):
    rows = [(i, "one", "x", 1, f"{i}\n") for i in range(n)]
    assert proven(spark, rows) == brute(rows)


def test_rounds_above_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(m, "LEVELS", 2)
    monkeypatch.setattr(m, "PER_PARTITION", 13)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "x", 1, f"{i}\n") for i in range(400)]
    assert proven(spark, rows) == brute(rows)


def test_written_proofs_fold_to_the_root_and_extra_columns_are_not_read(spark):
    rows = [(i, "a" if i % 4 else "b", "x", 1, f"t{i}", "clash", "clash") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA + ", grp string, part string")
    found = m.manifest(docs, with_proofs=True).collect()
    assert len(found) == 30 and all(m.fold(r.leaf, m.read_path(r.proof)) == r.root and r.verified for r in found)
    assert not any(m.fold(m.digest(["other"]), m.read_path(r.proof)) == r.root for r in found)


def test_a_partition_lacks_a_few_nodes_a_level_and_derives_the_rest():
    draw = random.Random(1)
    for n in [*range(1, 30), 81, 82, 243, 1000]:
        levels = tree([h(str(i)) for i in range(n)])
        cuts = sorted({0, n, *[draw.randrange(n + 1) for _ in range(4)]})
        passed = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            for level, i, x in m.inside(a, levels[0][a:b], n):
                assert levels[level][i] == x and (level, i) not in passed
                passed[level, i] = x
        for a, b in zip(cuts, cuts[1:], strict=False):
            lacks = m.missing(a, b - 1, n)
            assert len(lacks) == len(set(lacks)) <= 4 * m.height(n)
            derived = m.derive(a, levels[0][a:b], n, {c: levels[c[0]][c[1]] for c in lacks})
            assert derived[-1][1] == levels[-1]
            assert all(m.fold(levels[0][i], m.proof(i, derived)) == levels[-1][0] for i in range(a, b))
