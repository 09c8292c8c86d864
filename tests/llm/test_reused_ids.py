"""Dropping copies keeps rows, not ids: ids that come with several texts, null ids, each stage against brute force."""

import re

import pytest

import corpus_pipeline
from loomtrace.llm import exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute_near(rows):
    """One row of each component stays: the first by id (null last)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0, 0)), (doc_id is None, doc_id or 0, i)) if find(i) in best else (doc_id is None, doc_id or 0, i)
    return sorted((rows[i] for *_, i in best.values()), key=repr)


A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")


def test_an_id_with_two_texts_loses_neither(spark):
    rows = [(1, "A"), (1, "B"), (2, "a"), (None, "A"), (None, "n"), (3, None), (4, "")]
    assert kept(exact_dedup.drop_exact(table(spark, rows))) == sorted([(1, "B"), (2, "a"), (None, "n"), (4, "")], key=repr)
    rows = [(1, A), (1, B), (2, A + " end"), (5, B.upper()), (5, C), (None, C), (None, "n o p q r s"), (7, None), (8, "")]
    assert kept(near_dedup.drop_near(table(spark, rows))) == brute_near(rows)


def test_clashing_columns_and_reused_ids(spark):
    docs = spark.createDataFrame([(1, A, 5, "x"), (1, B, 6, "y"), (2, A, 7, "z")], "doc_id long, text string, place int, row string")
    got = near_dedup.drop_near(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, A, 5, "x"), (1, B, 6, "y")]


@pytest.mark.parametrize("reused", [False, True])
def test_stages_equal_brute_force(spark, reused):
    rows = [(k, t) for k, t in enumerate([A, A.upper(), A + " end", B, C, C + " x y", "short text", "Short Text", "", None, B + " z", "one more of its own kind here"])]
    if reused:
        rows += [(3, C), (None, B), (4, "one text more under a used id")]
    exact = corpus_pipeline.drop_copies(spark, table(spark, rows), None)
    lower = lambda t: (t or "").lower()
    largest = {}
    for i, t in rows:
        largest[lower(t)] = max(largest.get(lower(t), -1), -1 if i is None else i)
    wanted = [(i, t) for i, t in rows if (-1 if i is None else i) == largest[lower(t)]]
    assert kept(exact) == sorted(wanted, key=repr)
    assert kept(corpus_pipeline.drop_near_copies(spark, table(spark, wanted), None)) == brute_near(wanted)
