"""Removal of repeated passages by merging Burrows-Wheeler transforms of shards.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller id.

1. Texts. Of equal texts only the least id's is looked at; the others lose all bytes. These texts are
   moved once, into buckets of doc_id, and stay there.
2. Anchors. Every LENGTH-byte window has a minimiser, the least hash of its GRAM-byte strings. Runs
   of windows with the same minimiser are found for whole texts; equal windows have equal minimisers,
   so only windows whose minimiser occurs in two different texts can repeat.
3. Pieces. The runs with shared anchors, as strings, kept once per partition, with the places where
   they occur. Runs of an anchor found in very many texts are cut into single windows, which then
   spread over all tasks by their own hash. Strings travel to their range of anchors, all of a
   partition's for a range in one row; places stay.
4. Shards. A range's distinct pieces are cut into merges of whole anchors, and a merge's into shards in
   the order of the partitions that have them first; each shard gets its Burrows-Wheeler transform.
5. Merge. The transforms are merged by iterative interleave refinement: a round sorts the interleave
   stably by the preceding symbols, so that it is right for prefixes that are longer by as many, and
   the boundaries it adds are common prefixes that end there. Only rows that have LENGTH symbols before
   them set out, as only they end as windows. After LENGTH symbols the blocks left are the repeated
   intervals; no suffix is compared or sorted again.
6. The least id of each interval goes back to the partitions that have its pieces, which turn it into
   byte ranges at their places, and the bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import discard, documents, drop_buckets, slices, stored, stored_by

LENGTH = 50
GRAM = 24
#: Most windows of a piece.
MOST_WINDOWS = 48
#: An anchor found in more texts than this is hot: its windows are dealt out one by one.
HOT = 20_000
#: Bytes of text whose anchors one task should compare; so many also lie in a bucket of texts, up to Spark's bound on their number.
PER_BUCKET, MOST_BUCKETS = 24_000_000, 100_000
#: Bytes of text after which a partition hands on the anchors, and bytes of pieces after which it hands on the pieces found so far.
FLUSH, FLUSH_PIECES = 24_000_000, 24_000_000
#: Bytes of text whose anchors are found at once.
AT_ONCE = 64_000
#: Bytes of distinct pieces that one merge should hold, and about the most bytes of one of its shards.
PER_MERGE, PER_SHARD = 200_000, 40_000
#: Never a byte of UTF-8 text; stands for NUL, which ends pieces.
_NUL = 0xC0
_ENDED = bytes([_NUL, *range(1, 256)])
#: Most distinct symbols that one radix sort takes, and most pairs of symbols that are numbered by a table.
_KEYS, _PAIRS = 1 << 16, 1 << 24

_ZERO = np.zeros(1, np.int64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def window_minimisers(data: bytes) -> np.ndarray:
    """The least GRAM-byte hash in each LENGTH-byte window of data."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    grams = len(data) - GRAM + 1
    load = lambda at: np.ndarray((grams,), "<u8", data, at, (1,))  # noqa: E731  the 8 bytes from each place
    with np.errstate(over="ignore"):
        h = load(0) * _A
        for at in range(8, GRAM, 8):
            h ^= h >> np.uint64(32)
            h += load(min(at, GRAM - 8)) * _B
        h ^= h >> np.uint64(32)
        h *= _C
        h ^= h >> np.uint64(29)
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[width - have : width - have + n])


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, text, first window (a place in the joined texts) and window count of the runs of equal minimisers, MOST_WINDOWS at most each."""
    m = window_minimisers(b"".join(texts))
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    begins = np.append(_ZERO, ends[:-1])
    fresh = np.append(True, m[1:] != m[:-1])[: len(m)]
    for at in (begins, np.maximum(begins, ends - (LENGTH - 1))):  # a text's first window, and the first that reaches into the next text
        fresh[at[at < len(m)]] = True
    starts = np.flatnonzero(fresh)
    counts = np.diff(starts, append=len(m))
    text = np.searchsorted(ends, starts, "right")
    inside = starts + LENGTH <= ends[text]
    starts, counts, text = starts[inside], counts[inside], text[inside]
    if len(counts) and counts.max() > MOST_WINDOWS:
        parts = -(-counts // MOST_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + counts, parts)
        starts = np.repeat(starts, parts) + nth * MOST_WINDOWS
        counts, text = np.minimum(MOST_WINDOWS, ends - starts), np.repeat(text, parts)
    return m[starts], text, starts, counts


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values of x begin, and its end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)]), len(x))


def _batch(rows: list[tuple], names: str, numbers: int) -> pa.RecordBatch:
    """Rows of so many numbers, then binary values."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < numbers else pa.binary()) for k, c in enumerate(columns)], names.split())


def _anchors(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (bucket, anchors, counts, ids): the anchors of one document after the other, with their number and its id (as a difference)."""

    def packed(ids: list[np.ndarray], sets: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        anchors, place = np.concatenate(sets), np.concatenate(places)
        bucket = ((anchors >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # 16-bit numbers are sorted by radix
        order = np.argsort(bucket, kind="stable")
        anchors, place, bucket = anchors[order].astype("<u4"), place[order], bucket[order]
        ids, edges, rows = np.concatenate(ids).astype("<i8"), _edges(bucket), []
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            own = _edges(place[s:e])
            rows.append(
                (
                    int(bucket[s]),
                    anchors[s:e].tobytes(),
                    np.diff(own).astype("<u4").tobytes(),
                    np.diff(ids[place[s:e][own[:-1]]], prepend=0).tobytes(),
                )
            )
        yield _batch(rows, "bucket anchors counts ids", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        places: list[np.ndarray] = []
        held = n = 0
        for batch in (x for whole in batches for x in slices(whole, most=AT_ONCE)):
            texts = [encoded(x) for x in batch.column(1).to_pylist()]
            anchor, text = runs(texts)[:2]
            ids.append(batch.column(0).to_numpy())
            sets.append(anchor)
            places.append(n + text)
            held, n = held + sum(map(len, texts)), n + len(texts)
            if held > FLUSH:
                yield from packed(ids, sets, places)
                ids, sets, places, held, n = [], [], [], 0, 0
        yield from packed(ids, sets, places)

    return run


def _shared(groups: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rows (own, ids, counts, anchors, hot): per group of documents, the anchors of each that another text has too; hot ones are marked."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        read = lambda column, kind: [np.frombuffer(x, kind) for x in bucket[column]]
        ids = np.concatenate([np.cumsum(x) for x in read("ids", "<i8")])
        found = np.concatenate(read("anchors", "<u4")).astype(np.uint64) << np.uint64(32)
        found |= np.repeat(np.arange(len(ids), dtype=np.uint64), np.concatenate(read("counts", "<u4")))
        found.sort()
        found = found[np.append(True, found[1:] != found[:-1])]
        n = np.diff(_edges(found >> np.uint64(32)))
        found = found[np.repeat(n, n) > 1]  # in two rows at least
        anchors, doc = (found >> np.uint64(32)).astype("<u4"), ids[(found & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        order = np.lexsort((doc, anchors))
        anchors, doc = anchors[order], doc[order]
        fresh = np.append(True, (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]  # a repeated row adds nothing
        anchors, doc = anchors[fresh], doc[fresh]
        n = np.diff(_edges(anchors))
        n = np.repeat(n, n)
        anchors, doc, hot = anchors[n > 1], doc[n > 1], n[n > 1] > HOT
        group = _group(doc, groups)
        order = np.lexsort((doc, group))
        anchors, doc, hot, group = anchors[order], doc[order], hot[order], group[order]
        rows, edges = [], _edges(group)
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            own = _edges(doc[s:e])
            rows.append(
                (
                    int(group[s]),
                    doc[s:e][own[:-1]].tobytes(),
                    np.diff(own).astype("<u4").tobytes(),
                    anchors[s:e].tobytes(),
                    np.packbits(hot[s:e]).tobytes(),
                )
            )
        return pd.DataFrame(rows, columns=["own", "ids", "counts", "anchors", "hot"])

    return run


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are wanted."""
    if not len(wanted) or not len(values):
        return np.zeros(len(values), bool)
    wanted = np.sort(wanted)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((doc.view(np.uint64) * _A) >> np.uint64(33)).astype(np.int64) % groups


def _of_documents(rows: pd.DataFrame) -> pd.DataFrame:
    """doc_id, shared, hot of a group of documents, from all buckets of anchors."""
    read = lambda column, kind: [np.frombuffer(x, kind) for x in rows[column]]
    anchors = read("anchors", "<u4")
    hot = np.concatenate([np.unpackbits(h)[: len(a)] for a, h in zip(anchors, read("hot", np.uint8), strict=True)]).astype(bool)
    doc = np.repeat(np.concatenate(read("ids", "<i8")), np.concatenate(read("counts", "<u4")))
    anchors = np.concatenate(anchors)
    order = np.argsort(doc, kind="stable")
    anchors, hot, doc = anchors[order], hot[order], doc[order]
    edges = _edges(doc)
    out = [(int(doc[s]), anchors[s:e][~hot[s:e]].tobytes(), anchors[s:e][hot[s:e]].tobytes()) for s, e in zip(edges[:-1], edges[1:], strict=True)]
    return pd.DataFrame(out, columns=["doc_id", "shared", "hot"])


PIECES = "source long, merge long, strings binary, parts binary, least binary, most binary, own binary, docs binary, starts binary"


class _Found:
    """The distinct pieces of a source so far, and which occurs in which document where."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.places: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, joined: bytes, routes: np.ndarray, docs: np.ndarray, starts: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        """Pieces of joined texts, from place at; starts are places in their documents."""
        number, known = self.number, len(self.number)
        own = [number.setdefault(joined[s:e], len(number)) for s, e in zip(at.tolist(), (at + sizes).tolist(), strict=True)]
        own = np.array(own, np.int64)
        self.places.append((own, routes, docs.astype("<i8"), starts.astype("<i4")))
        self.held += 16 * len(own) + (LENGTH + MOST_WINDOWS // 2) * (len(number) - known)

    def rows(self, source: int, ranges: int, first: int) -> list[tuple]:
        """Rows PIECES, one for each range, numbered from first; a range's pieces lie in the order of the parts it can be cut into."""
        if not self.number:
            return []
        own, routes, docs, starts = (np.concatenate(x) for x in zip(*self.places, strict=True))
        route = np.empty(len(self.number), np.uint64)
        route[own] = routes
        to, part = (route % np.uint64(ranges)).astype(np.int64), (route // np.uint64(ranges)).astype("<u2")
        order = np.lexsort((part, to))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        to, part, pieces, own = to[order], part[order], list(self.number), place[own]
        least, most = np.full(len(pieces), np.iinfo(np.int64).max), np.full(len(pieces), np.iinfo(np.int64).min)
        np.minimum.at(least, own, docs)
        np.maximum.at(most, own, docs)
        by_range = np.argsort(to[own], kind="stable")
        own, docs, starts = own[by_range], docs[by_range], starts[by_range]
        edges = _edges(to)
        there = np.append(_ZERO, np.cumsum(np.bincount(to[own], minlength=ranges)))
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = int(to[a])
            s, e = there[k], there[k + 1]
            columns = part[a:b], least[a:b], most[a:b], (own[s:e] - a).astype("<i4"), docs[s:e], starts[s:e]
            rows.append((source, first + k, b"\0".join([pieces[i] for i in order[a:b].tolist()]), *(x.tobytes() for x in columns)))
        return rows


def _wanted(text: np.ndarray, anchor: np.ndarray, sets: list[bytes]) -> np.ndarray:
    """Which anchors of a text are in its set."""
    wanted = np.repeat(np.arange(len(sets)), [len(x) // 4 for x in sets]) << 32 | np.frombuffer(b"".join(sets), "<u4")
    return _among(text << 32 | anchor.astype("<u4"), wanted)


def _pieces(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows PIECES: a source's distinct pieces of a range, and which occurs in which document where. Windows of hot anchors have ranges of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, cold, hot = TaskContext.get().partitionId() << 24, _Found(), _Found()
        packed = lambda: _batch(cold.rows(source, ranges, 0) + hot.rows(source, ranges, ranges), "source merge strings parts least most own docs starts", 2)
        for batch in (x for whole in batches for x in slices(whole, most=AT_ONCE)):
            texts = [encoded(x) for x in batch.column(1).to_pylist()]
            anchor, text, start, count = runs(texts)
            joined = b"".join(texts).translate(_ENDED)
            ids, sizes = batch.column(0).to_numpy(), np.array([len(x) for x in texts])
            begins = np.cumsum(sizes) - sizes
            own = _wanted(text, anchor, batch.column(2).to_pylist())
            doc, at = text[own], start[own]
            cold.add(joined, anchor[own], ids[doc], at - begins[doc], at, count[own] + (LENGTH - 1))
            own = _wanted(text, anchor, batch.column(3).to_pylist())
            if own.any():
                doc, at = np.repeat(text[own], count[own]), _slices(start[own], count[own])
                routes = [xxhash.xxh3_64_intdigest(joined[s : s + LENGTH]) for s in at.tolist()]
                hot.add(joined, np.array(routes, np.uint64), ids[doc], at - begins[doc], at, np.full(len(at), LENGTH))
            if cold.held + hot.held > FLUSH_PIECES:
                yield packed()
                source, cold, hot = source + 1, _Found(), _Found()
        yield packed()

    return run


def suffix_array(joined: bytes) -> np.ndarray:
    """Suffix array of pieces that are sorted, distinct and each ended by NUL: by 8 bytes, then by doubling the prefixes of those still equal.

    128 bytes decide, as pieces are shorter; what is equal so far is in the order of the pieces.
    """
    n = len(joined)
    padded = joined + b"\xff" * 8  # the last end mark comes after the others
    kind = np.uint16 if n < 65_000 else np.int64  # numpy sorts 16-bit numbers by radix
    order = np.arange(n)
    for at in (6, 4, 2, 0):
        order = order[np.argsort(np.ndarray((n,), ">u2", padded, at, (1,)).astype(np.uint16)[order], kind="stable")]
    ahead = np.ndarray((n,), "<u8", padded, 0, (1,))[order]
    fresh = np.append(True, ahead[1:] != ahead[:-1])
    rank, at, own, have = np.empty(n + 1, kind), np.arange(n), order, 8
    rank[n] = n
    while True:
        rank[own] = np.maximum.accumulate(np.where(fresh, at, 0))  # where its equals begin
        tied = ~(fresh & np.append(fresh[1:], True))
        if have >= 128 or not tied.any():
            return order
        at, own = at[tied], own[tied]
        before, after = rank[own], rank[np.minimum(own + have, n)]
        within = np.argsort(after, kind="stable")
        within = within[np.argsort(before[within], kind="stable")]
        own, before, after = own[within], before[within], after[within]
        order[at] = own
        fresh = np.append(True, (before[1:] != before[:-1]) | (after[1:] != after[:-1]))
        have *= 2


def transform(pieces: list[bytes]) -> bytes:
    """The Burrows-Wheeler transform of sorted distinct pieces, each ended by NUL."""
    joined = b"\0".join(pieces) + b"\0"
    return np.frombuffer(joined, np.uint8)[suffix_array(joined) - 1].tobytes()


def last_to_first(bwt: np.ndarray) -> np.ndarray:
    """The row of the suffix that is one symbol longer, for each row."""
    out = np.empty(len(bwt), np.int64)
    out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    return out


def rows_of_pieces(bwt: np.ndarray, lengths: np.ndarray, step: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Piece and offset of each row, by walking backwards from all pieces' ends at once.

    With step and ends, of the rows of several transforms; ends has the row of each piece's end.
    """
    step = last_to_first(bwt) if step is None else step
    piece, offset = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    own, at = np.arange(len(lengths), dtype=np.int32), lengths.astype(np.int32)
    row = own if ends is None else ends
    while len(own):
        piece[row], offset[row] = own, at
        more = bwt[row] != 0
        own, row, at = own[more], step[row[more]], at[more] - 1
    return piece, offset


def _steps(transforms: list[np.ndarray]) -> np.ndarray:
    """The row of the suffix that is one symbol longer, for each row, numbered through the transforms."""
    shift = np.cumsum([0, *map(len, transforms)])
    return np.concatenate([last_to_first(t) + s for t, s in zip(transforms, shift, strict=False)]).astype(np.int32)


def _symbols(bwt: np.ndarray, step: np.ndarray, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, key, step): the preceding width symbols of each row as one number, in their order, and the row of the suffix longer by them."""
    levels = [(1, bwt, step)]
    while True:
        width, key, step = levels[-1]
        n = int(key.max()) + 1
        if n * n > _PAIRS or 2 * width > most:
            return levels
        pair = key[step].astype(np.int64) * n + key
        there = np.zeros(n * n, bool)
        there[pair] = True
        found = np.flatnonzero(there)
        if len(found) > _KEYS:
            return levels
        number = np.empty(n * n, np.uint16)
        number[found] = np.arange(len(found))
        levels.append((2 * width, number[pair], step[step]))


def interleave(transforms: list[np.ndarray], depth: int, step: np.ndarray | None = None, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of all rows (numbered through the transforms) for prefixes of depth bytes, and where blocks of equal prefixes begin.

    With rows (ascending, depth symbols before each in its piece) only the suffixes that are longer by
    depth than those. A round takes several preceding symbols at once where so few strings of them
    occur that they are sorted by radix.
    """
    bwt = np.concatenate(transforms)
    levels = _symbols(bwt, _steps(transforms) if step is None else step, depth)
    rows = np.arange(len(bwt), dtype=np.int32) if rows is None else rows.astype(np.int32)  # no prefix yet: one block, shard after shard
    block = np.zeros(len(rows), np.int32)
    begins = np.zeros(len(rows), bool)
    begins[:1] = True
    while depth:
        width, key, step = next(x for x in reversed(levels) if x[0] <= depth)
        symbol = key.take(rows)
        order = np.argsort(symbol, kind="stable")
        rows, ahead, symbol = rows.take(order), block.take(order), symbol.take(order)
        np.logical_or(symbol[1:] != symbol[:-1], ahead[1:] != ahead[:-1], out=begins[1:])  # common prefix below the round's
        block = np.cumsum(begins, dtype=np.int32)
        rows = step.take(rows)  # the suffixes longer by width symbols; a shard's rows keep their order
        depth -= width
    return rows, begins


def _slices(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, then the same of the next."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _repeats(pieces: list[bytes], least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first, last and best: windows first..last of a piece, some place of which lies behind document best, the least that has them.

    pieces are distinct, in the order of the partitions that have them first.
    """
    ends = np.cumsum([len(x) + 1 for x in pieces])
    cuts = np.searchsorted(ends, np.linspace(0, ends[-1], max(2, -(-int(ends[-1]) // PER_SHARD)) + 1)[1:-1], "right")
    own = [sorted(range(a, b), key=pieces.__getitem__) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pieces)], strict=True) if a < b]
    bwts = [np.frombuffer(transform([pieces[k] for k in x]), np.uint8) for x in own]
    first_rows = np.cumsum([0, *map(len, bwts)])[:-1]
    step = _steps(bwts)
    name = np.concatenate([np.array(x) for x in own])
    length = np.diff(ends, prepend=0)[name] - 1
    piece, offset = rows_of_pieces(np.concatenate(bwts), length, step, np.concatenate([s + np.arange(len(x)) for s, x in zip(first_rows, own, strict=True)]))
    order, begins = interleave(bwts, LENGTH, step, np.flatnonzero(offset >= LENGTH))
    piece, offset = name[piece[order]], offset[order]
    first = np.flatnonzero(begins)
    best = np.repeat(np.minimum.reduceat(least[piece], first), np.diff(np.append(first, len(order))))
    hit = best < most[piece]
    piece, offset, best = piece[hit], offset[hit], best[hit]
    order = np.lexsort((offset, piece))
    piece, offset, best = piece[order], offset[order], best[order]
    start = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1) | (best[1:] != best[:-1]))[: len(piece)])
    end = np.append(start[1:], len(piece)) - 1 if len(start) else start
    return piece[start], offset[start].astype("<i4"), offset[end].astype("<i4"), best[start]


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (source, merge, pieces, firsts, lasts, leasts): which windows first..last of a source's pieces an earlier document has too, and the least that has."""
    rows = rows.sort_values("source")
    number: dict[bytes, int] = {}
    named = [np.array([number.setdefault(x, len(number)) for x in strings.split(b"\0")], np.int64) for strings in rows["strings"]]
    pieces, part = list(number), np.empty(len(number), np.uint16)
    least, most = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).min)
    mosts = [np.frombuffer(x, "<i8") for x in rows["most"]]
    for k, own, lo, hi in zip(named, rows["parts"], rows["least"], mosts, strict=True):
        part[k] = np.frombuffer(own, "<u2")
        np.minimum.at(least, k, np.frombuffer(lo, "<i8"))
        np.maximum.at(most, k, hi)
    # merges of about one size, cut between parts, so that all pieces of an anchor are in one
    order = np.argsort(part, kind="stable")
    begins = _edges(part[order])[:-1]
    before = (np.cumsum([0, *(len(pieces[k]) + 1 for k in order.tolist())])[begins]) // PER_MERGE
    cuts = [*begins[_edges(before)[:-1]], len(order)]
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.sort(order[a:b])
        piece, *rest = _repeats([pieces[k] for k in own.tolist()], least[own], most[own])
        found.append((own[piece], *rest))
    piece, first, last, best = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(piece, kind="stable")
    piece, first, last, best = piece[order], first[order], last[order], best[order]
    low, high = np.searchsorted(piece, np.arange(len(number)), "left"), np.searchsorted(piece, np.arange(len(number)), "right")
    out = []
    for source, merge, k, hi in zip(rows["source"], rows["merge"], named, mosts, strict=True):
        n = high[k] - low[k]
        at, local = _slices(low[k], n), np.repeat(np.arange(len(k)), n)
        useful = best[at] < hi[local]
        at, local = at[useful], local[useful]
        if len(at):
            out.append((source, merge, local.astype("<i4").tobytes(), first[at].tobytes(), last[at].tobytes(), best[at].tobytes()))
    return pd.DataFrame(out, columns=["source", "merge", "pieces", "firsts", "lasts", "leasts"])


def _ranges(places: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """doc_id, starts, ends: the byte ranges to remove of a source's documents."""
    out = {"doc_id": [], "starts": [], "ends": []}
    if len(places) and len(found):
        places = places.set_index("merge").loc[found["merge"]]
        read = lambda df, column, kind: [np.frombuffer(x, kind) for x in df[column]]
        own = read(places, "own", "<i4")
        shift = np.cumsum([0, *(int(x.max()) + 1 for x in own)])[:-1]  # pieces numbered through the merges
        own = np.concatenate([x + s for x, s in zip(own, shift, strict=True)])
        docs, starts = np.concatenate(read(places, "docs", "<i8")), np.concatenate(read(places, "starts", "<i4"))
        order = np.argsort(own, kind="stable")
        own, docs, starts = own[order], docs[order], starts[order]
        piece = np.concatenate([x + s for x, s in zip(read(found, "pieces", "<i4"), shift, strict=True)])
        first, last, least = (np.concatenate(read(found, c, k)) for c, k in (("firsts", "<i4"), ("lasts", "<i4"), ("leasts", "<i8")))
        low = np.searchsorted(own, piece, "left")
        n = np.searchsorted(own, piece, "right") - low
        at, of = _slices(low, n), np.repeat(np.arange(len(piece)), n)
        later = least[of] < docs[at]
        at, of = at[later], of[later]
        doc, s, e = docs[at], (starts[at] + first[of]).astype("<i4"), (starts[at] + last[of] + LENGTH).astype("<i4")
        order = np.argsort(doc, kind="stable")
        doc, s, e = doc[order], s[order], e[order]
        edges = _edges(doc)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for c, v in zip(out.values(), (int(doc[a]), s[a:b].tobytes(), e[a:b].tobytes()), strict=True):
                c.append(v)
    return pd.DataFrame(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_removed, n_spans, kept_sha256 from texts and the byte ranges to remove."""
    for batch in (x for whole in batches for x in slices(whole)):
        out: list[list] = [[], [], [], []]
        for i, x, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            data, s, e = encoded(x), np.frombuffer(starts, "<i4"), np.frombuffer(ends, "<i4")
            order = np.argsort(s)
            s, e = s[order], np.maximum.accumulate(e[order])
            first = np.flatnonzero(np.append(True, s[1:] > e[:-1]))  # ranges that touch are one span
            s, e = s[first], e[np.append(first[1:], len(e)) - 1]
            kept = b"".join([data[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(data)], strict=True)])
            for c, v in zip(out, (i, len(data) - len(kept), len(s), hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            ["doc_id", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_ranges(texts: DataFrame, n_bytes: int) -> DataFrame:
    """Rows (doc_id, starts, ends): byte ranges that an earlier text has too. texts has doc_id and distinct texts, n_bytes in all."""
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PER_BUCKET))
    anchors = texts.mapInArrow(_anchors(n), "bucket long, anchors binary, counts binary, ids binary")
    shared = anchors.groupBy("bucket").applyInPandas(_shared(n), "own long, ids binary, counts binary, anchors binary, hot binary")
    of_documents = shared.groupBy("own").applyInPandas(_of_documents, "doc_id long, shared binary, hot binary")
    of_documents = stored(of_documents, "shared")
    wanted = texts.join(of_documents.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "shared", "hot")
    pieces = stored(wanted.mapInArrow(_pieces(2 * n), PIECES), "pieces")  # so many ranges that their hashes spread them evenly
    discard(of_documents)
    merged = pieces.select("source", "merge", "strings", "parts", "least", "most").groupBy("merge")
    found = stored(merged.applyInPandas(_merged, "source long, merge long, pieces binary, firsts binary, lasts binary, leasts binary"), "intervals")
    places = pieces.select("source", "merge", "own", "docs", "starts").groupBy("source")
    ranges = places.cogroup(found.groupBy("source")).applyInPandas(_ranges, "doc_id long, starts binary, ends binary")
    ranges = stored(ranges, "ranges")
    discard(pieces, found)
    return ranges


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Null counts as empty; texts under LENGTH bytes lose nothing. Rows that repeat an id and text are
    the same document. An empty table gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    narrow = stored(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "narrow")
    least = stored(narrow.groupBy("sha").agg(F.min("doc_id").alias("least"), F.first("n_bytes").alias("n")), "least")
    whole = least.filter(F.col("n") >= LENGTH)
    n_bytes = whole.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-n_bytes // PER_BUCKET)))
    firsts = whole.select(F.col("least").alias("doc_id")).repartition(n, "doc_id").hint("shuffle_hash")
    texts = stored_by(rows.repartition(n, "doc_id").join(firsts, "doc_id"), "doc_id", "texts", n)
    ranges = repeated_ranges(texts, n_bytes)
    cut = texts.join(ranges.hint("shuffle_hash"), "doc_id").mapInArrow(_cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string")
    cut = stored(cut.dropDuplicates(["doc_id"]), "cut")
    drop_buckets(texts)
    discard(ranges)
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    joined = narrow.join(least.select("sha", "least"), "sha").join(cut, "doc_id", "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, unnest(list_transform(range(0, length(h) // 2 - 49), lambda i: {'p': i, 'k': hash(substr(h, 2 * i + 1, 100))}), recursive := true) FROM d
), m AS (
  SELECT k, min(doc_id) AS least FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)
), v AS (
  SELECT w.doc_id, w.p, true AS gone FROM w JOIN m USING (k) WHERE m.least < w.doc_id
), g AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM v WHERE gone
), r AS (
  SELECT doc_id, p, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g
), s AS (
  SELECT doc_id, span, min(p) AS s, max(p) + 50 AS e FROM r GROUP BY doc_id, span
), k AS (
  SELECT doc_id, s, e, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS nth FROM s
), t AS (
  SELECT k.doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(CASE WHEN nth = 1 THEN substr(h, 1, 2 * s) ELSE '' END || substr(h, 2 * e + 1, 2 * (coalesce(nxt, length(h) // 2) - e)), '' ORDER BY s) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY k.doc_id
)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN t.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
