"""Suffix dedup: rows of pieces by ranges, merges within a range, rows that set out in a merge, suffix arrays of periodic pieces."""

import random

import numpy as np
import pandas as pd
import pytest

from loomtrace.llm import suffix_dedup
from loomtrace.llm.suffix_dedup import LENGTH


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(n))


def test_rows_of_pieces_do_not_grow_with_shared_anchors(spark, monkeypatch):
    draw, counts, stored = random.Random(3), [], suffix_dedup.stored
    texts = [prose(draw, 300) for _ in range(1600)]

    def counted(df, name, *more):
        out = stored(df, name, *more)
        if name == "pieces":
            counts.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "stored", counted)
    for n in (400, 1600):
        rows = [(k * n + i, "xy"[k] + " " + t) for k in range(2) for i, t in enumerate(texts[:n])]
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == {i: len(t) - 1 if i >= n else 0 for i, t in rows}
    assert counts[1] <= counts[0] <= 4 * 8  # sources and ranges; four times the anchors before: four times the rows of each source


def test_only_rows_that_end_as_windows_set_out():
    draw = random.Random(4)
    pieces = [sorted({bytes(draw.choice(b"ab") for _ in range(draw.randint(3, 60))) for _ in range(8)}) for _ in range(4)]
    bwts = [np.frombuffer(suffix_dedup.transform(p), np.uint8) for p in pieces]
    left = np.concatenate([np.array([len(p[i]) for i in own]) - at for p, b in zip(pieces, bwts) for own, at in [suffix_dedup.rows_of_pieces(b, np.array([*map(len, p)]))]])
    offset = np.concatenate([suffix_dedup.rows_of_pieces(b, np.array([*map(len, p)]))[1] for p, b in zip(pieces, bwts)])
    for depth in (1, 7, 20):
        rows, begins = suffix_dedup.interleave(bwts, depth)
        whole = left[rows] >= depth
        some, edges = suffix_dedup.interleave(bwts, depth, rows=np.flatnonzero(offset >= depth))
        assert list(some) == list(rows[whole])
        assert list(np.cumsum(edges)) == list(np.unique(np.cumsum(begins)[whole], return_inverse=True)[1] + 1)


@pytest.mark.parametrize("letters", [b"ab", b"a", b"abcdefghij"])
def test_suffix_array_of_long_pieces(letters):
    draw = random.Random(5)
    cores = [bytes(draw.choice(letters) for _ in range(97)) for _ in range(5)]
    pieces = sorted({c[draw.randint(0, 40) : draw.randint(60, 97)] for c in cores for _ in range(30)})
    joined = b"\0".join(pieces) + b"\0"
    places = [(p[k:], i, k) for i, p in enumerate(pieces) for k in range(len(p) + 1)]
    begins = np.cumsum([0, *(len(p) + 1 for p in pieces)])
    assert list(suffix_dedup.suffix_array(joined)) == [begins[i] + k for _, i, k in sorted(places)]


@pytest.mark.parametrize("most", [300, 100_000])
def test_merges_of_a_range_find_every_repeated_window(monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "PER_MERGE", most)
    monkeypatch.setattr(suffix_dedup, "PER_SHARD", most // 2)
    draw = random.Random(6)
    cores = [prose(draw, 40) for _ in range(6)] + ["ab" * 100, "x" * 120]
    texts = [x.encode() for x in (prose(draw, 5) + draw.choice(cores)[draw.randint(0, 60) :] + prose(draw, 5) for _ in range(40))] + [b"", b"short"]
    rows, docs_of = [], {}
    for source, own in enumerate((range(0, 20), range(20, 42))):
        found = suffix_dedup._Found()
        mine = [texts[i] for i in own]
        anchor, text, start, count = suffix_dedup.runs(mine)
        begins = np.cumsum([0, *map(len, mine)])
        assert count.sum() == sum(max(0, len(x) - LENGTH + 1) for x in mine)
        found.add(b"".join(mine), anchor, np.array(own)[text], start - begins[text], start, count + LENGTH - 1)
        rows += found.rows(source, 1, 0)
        for i in own:
            for s in range(len(texts[i]) - LENGTH + 1):
                docs_of.setdefault(texts[i][s : s + LENGTH], set()).add(i)
    table = pd.DataFrame(rows, columns="source merge strings parts least most own docs starts".split())
    ranges = {}
    for source in range(2):
        own = table[table["source"] == source]
        out = suffix_dedup._merged(table)
        for r in suffix_dedup._ranges(own, out[out["source"] == source]).itertuples():
            for s, e in zip(np.frombuffer(r.starts, "<i4"), np.frombuffer(r.ends, "<i4")):
                ranges.setdefault(r.doc_id, set()).update(range(s, e - LENGTH + 1))
    wanted = {i: {s for s in range(len(x) - LENGTH + 1) if min(docs_of[x[s : s + LENGTH]]) < i} for i, x in enumerate(texts)}
    assert ranges == {i: s for i, s in wanted.items() if s}
