"""Fingerprints against a plain one-permutation MinHash, and their estimates against whole shingle sets."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtrace.llm import fingerprint as fp

SCHEMA = "doc_id long, text string"


def chained(parts, seed=42):
    for x in parts:
        seed = xxhash.xxh64_intdigest(x, seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def shingles(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return [tuple(ws[i : i + fp.SHINGLE]) for i in range(max(1, len(ws) - fp.SHINGLE + 1))] if ws else []


def brute(text):
    """Hexadecimal digits of the fingerprint, as fp.as_text()."""
    hashes = [chained([w.encode() for w in s]) for s in shingles(text)]
    if not hashes:
        return ""
    bins = {}
    for h in hashes:
        bins[h >> fp._SHIFT] = min(bins.get(h >> fp._SHIFT, h), h)
    full = []
    for i in range(fp.BINS):
        first = next((j for j in [i, *fp.probe_sequence(i)] if j in bins), None)
        if first is None:  # all filled bins in this bin's own order
            first = min(bins, key=lambda b: signed(chained([int(b).to_bytes(8, "little")], chained([i.to_bytes(8, "little")]))))
        full.append(bins[first] & 255)
    return "".join(bytes(reversed(full[k : k + 8])).hex().upper() for k in range(0, fp.BINS, 8))


def test_fingerprints_equal_brute_force(spark):
    texts = [" ".join(f"w{(i * k) % 37}" for k in range(i)) for i in (1, 2, 4, 5, 6, 9, 30, 200, 900)]
    texts += ["", None, " \n\t", "ÀB ça  va\x0bbien", "  A b C d E f ", "a b c d e f", "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(fp.as_text(fp.fingerprint(F.col("text")))).collect()
    assert [r[0] for r in got] == [brute(t) for t in texts]


def test_rows_follow_each_other_and_are_edited(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 3)
    rows = [(i * 10, f"plum{i} tree, " * (i % 5) + "é🎉" * i) for i in range(25)] + [(45, None), (46, ""), (300, "last of all")]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    rows.sort()
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute(text) and r.edited_fingerprint == brute(edited)
        assert (r.near_next == 1.0) == (brute(text) == brute(following))


def test_repeated_rows_single_rows_empty_tables_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "h i j k l m"), (None, None), (2, "a")]
    got = fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and sorted(r.near_next for r in got if r.doc_id == 1) == [0.0, 1.0]
    one = fp.fingerprints(spark.createDataFrame([(1, "a b c d e f", 2, "x")], "doc_id long, text string, place long, packed string")).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 11)]
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("shared", [0, 100, 300, 500])
def test_likeness_is_near_the_true_one(spark, shared):
    """256 bins: the standard error of the estimate is at most 0.032; the mean of 40 pairs lies far closer."""
    draw = np.random.default_rng(shared)
    pairs, true = [], []
    for _ in range(40):
        common, a, b = ([f"w{x}" for x in draw.integers(0, 10**9, n)] for n in (shared, 500 - shared, 500 - shared))
        a, b = " ".join(common + a), " ".join(common + b)
        x, y = set(shingles(a)), set(shingles(b))
        pairs.append((a, b))
        true.append(len(x & y) / len(x | y))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = np.array([r[0] for r in df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()])
    assert abs(got.mean() - np.mean(true)) < 0.025 and np.abs(got - true).max() < 0.2


def test_short_texts_are_estimated_without_bias(spark):
    """Ten shingles in 256 bins: most bins are filled from others."""
    draw = np.random.default_rng(3)
    pairs = []
    for _ in range(300):
        ws = [f"w{x}" for x in draw.integers(0, 10**9, 14)]
        pairs.append((" ".join(ws), " ".join([*ws[:10], *[f"w{x}" for x in draw.integers(0, 10**9, 4)]])))  # 6 of 14 in common
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()]
    assert abs(np.mean(got) - 6 / 14) < 0.04
