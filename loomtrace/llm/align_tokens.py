"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. Where a token of each ends at one byte, the text can be cut:
from the middle of an interval the nearest end that both share is looked up by bisect, the interval
is split there and both halves are done likewise; an interval without a shared end is a group. All
pairs of an A token and a B token of one group are links.

A space behind a character that isn't white space is a shared cut by the tokenizers' own rules
(neither has a token over it), so a text is first cut there, and each distinct chunk is encoded and
divided once per worker. A text of which some chunk doesn't keep its bytes is done again as a whole.

All chunks of a batch are divided together, level by level, on arrays. A document's links are kept as distinct id pairs with their numbers, whatever the size of its groups.
Documents per pair are counted with map-side combining; frequent pairs, of which there are few by
definition, then meet the documents' links by broadcast and all others by a join on the pair.
"""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.bpe import byte_table
from loomtrace.llm.common import documents, slices, spread, stored

#: Bytes of text that a worker aligns at a time (a text at least).
SLICE = 500_000
#: Distinct chunks, and their characters and pairs, that a worker remembers; beyond that it starts anew.
REMEMBERED = 100_000, 2_500_000
#: Chunks that are encoded as one text.
JOINED = 64
#: Tries of all intervals together, after which the few left are searched one by one.
TRIES = 16
#: Links of a group that are written out one by one; larger groups are counted by distinct ids.
SMALL = 4_096
#: A pair with more than a FREQUENT-th of all (document, pair) rows is frequent; fewer than FREQUENT pairs can be.
FREQUENT = 100_000

#: A space at the start or behind white space is no cut.
_NO_CUT = r"(^|[\x09-\x0D\x1C-\x1F\x{85}\p{Z}]) "


def _cut_near_middle(a: list[int] | np.ndarray, b: list[int] | np.ndarray, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int] | None:
    """Behind which tokens a0 <= i < a1 - 1 and b0 <= j < b1 - 1 both end, nearest to the middle; None if nowhere."""
    middle = (a0 + a1) // 2 - 1
    for step in range(2 * (a1 - a0)):
        i = middle + (step + 1) // 2 * (1 if step % 2 else -1)
        if a0 <= i < a1 - 1:
            j = bisect_left(b, a[i], b0, b1 - 1)
            if j < b1 - 1 and b[j] == a[i]:
                return i + 1, j + 1
    return None


def shared_cuts(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Groups (rows: first A token, behind the last, first B token, behind the last; in order) of rising token ends a and b.

    bounds are intervals of the same form to begin with, whose last ends are the same. All intervals
    of a level are looked up together; those whose middle has no cut nearby are searched alone.
    """
    done, todo = [], bounds
    while len(todo):
        can = (todo[:, 1] - todo[:, 0] > 1) & (todo[:, 3] - todo[:, 2] > 1)
        done.append(todo[~can])
        todo = todo[can]
        cut = np.full((len(todo), 2), -1, np.int64)
        middle, left = (todo[:, 0] + todo[:, 1]) // 2 - 1, np.arange(len(todo))
        for step in range(TRIES):
            i = middle[left] + (step + 1) // 2 * (1 if step % 2 else -1)
            inside = (i >= todo[left, 0]) & (i < todo[left, 1] - 1)
            i = np.where(inside, i, 0)
            j = np.searchsorted(b, a[i])
            hit = inside & (b[j] == a[i])
            cut[left[hit], 0], cut[left[hit], 1] = i[hit] + 1, j[hit] + 1
            left = left[~hit & (2 * (todo[left, 1] - todo[left, 0]) > step)]
            if not len(left):
                break
        for k in left:
            cut[k] = _cut_near_middle(a, b, *todo[k].tolist()) or (-1, -1)
        found = cut[:, 0] >= 0
        done.append(todo[~found])
        todo, cut = todo[found], cut[found]
        todo = np.concatenate([
            np.column_stack([todo[:, 0], cut[:, 0], todo[:, 2], cut[:, 1]]),
            np.column_stack([cut[:, 0], todo[:, 1], cut[:, 1], todo[:, 3]]),
        ])
    out = np.concatenate(done) if done else bounds
    return out[np.argsort(out[:, 0], kind="stable")]


def chunks(text: str) -> list[str]:
    """space + text cut at each space behind no white space; each chunk without its first space."""
    parts = text.split(" ")
    out = parts[:1]
    for part in parts[1:]:
        if not out[-1] or out[-1][-1].isspace():
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return out


@lru_cache(maxsize=2)
def tokenizers_of(path_a: str, path_b: str):
    """Both tokenizers, and the bytes of each id of either."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(byte_table())}
    vocab = a.get_vocab()
    bytes_a = [b""] * (max(vocab.values()) + 1)
    for chars, i in vocab.items():
        bytes_a[i] = bytes(back[c] for c in chars) if all(c in back for c in chars) else chars.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("the B tokenizer has tokens over the start of a word")
    return a, b, bytes_a, bytes_b


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1, a row each, padded by zero bytes."""
    width = len(str(n))
    return np.array([str(i).encode() for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)


class Grown:
    """An array that grows at its end."""

    def __init__(self):
        self.data, self.n = np.zeros(1024, np.int64), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + 2 * len(more), np.int64)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.n]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Aligned chunks that a worker has seen: counts, groups as text, linked pairs with their times."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.bytes_a, self.bytes_b = tokenizers_of(path_a, path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        self.digits_a, self.digits_b = _digits(len(self.bytes_a)), _digits(len(self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.counts = {c: Grown() for c in COUNTS}
        self.n_pairs, self.pairs, self.times = Grown(), Grown(), Grown()
        self.characters = 0

    def learn(self, texts: list[str]) -> None:
        """Aligns texts that aren't known; a text's groups are None where a tokenizer doesn't keep its bytes."""
        # behind white space, or nothing, the next text's space would be no cut: such texts are encoded alone
        alone = [x for x in texts if not x or x[-1].isspace()]
        others = [x for x in texts if x and not x[-1].isspace()]
        if not self.align([*others, *alone], len(others)):
            for x in texts:  # some text doesn't keep its bytes
                if not self.align([x], 0):
                    self._append([x], [None], {c: np.zeros(1, np.int64) for c in COUNTS}, np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 2)

    def _append(self, texts: list[str], groups: list, counts: dict[str, np.ndarray], n_pairs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.number.update(zip(texts, range(len(self.groups), len(self.groups) + len(texts)), strict=True))
        self.groups += groups
        for c in COUNTS:
            self.counts[c].add(counts[c])
        for of, more in ((self.n_pairs, n_pairs), (self.pairs, pairs), (self.times, times)):
            of.add(more)
        self.characters += sum(map(len, texts))

    def align(self, texts: list[str], joined: int) -> bool:
        """Aligns and remembers space + each text, the first ones by many at a time; False, and nothing remembered, if bytes change."""
        units = [" ".join(texts[i : min(i + JOINED, joined)]) for i in range(0, joined, JOINED)] + texts[joined:]
        spaced = [f" {x}" for x in units]
        ids_a = [i for e in self.a.encode_batch_fast(spaced, add_special_tokens=False) for i in e.ids]
        ids_b = [i for e in self.b.encode(units, num_threads=1) for i in e]
        raw = "".join(spaced).encode("utf-8", "surrogatepass")
        if not (b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b))):
            return False
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum([len(x.encode("utf-8", "surrogatepass")) + 1 for x in texts])
        last_a, last_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1  # both have a token that ends there
        bounds = np.column_stack([np.append(0, last_a[:-1]), last_a, np.append(0, last_b[:-1]), last_b]).astype(np.int64)
        found = shared_cuts(ends_a, ends_b, bounds)
        of = np.searchsorted(last_a, found[:, 0], "right")  # the text of each group
        links = (found[:, 1] - found[:, 0]) * (found[:, 3] - found[:, 2])
        n = len(texts)
        counts = {
            "n_a": bounds[:, 1] - bounds[:, 0], "n_b": bounds[:, 3] - bounds[:, 2],
            "n_groups": np.bincount(of, minlength=n), "n_links": np.add.reduceat(links, np.searchsorted(of, np.arange(n))),
        }
        self._append(texts, self._written(a, b, found, bounds), counts, *self._pairs(a, b, found, of, links, n))
        return True

    def _written(self, a: np.ndarray, b: np.ndarray, found: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
        at_a = np.arange(len(a)) + np.repeat(found[:, 2], found[:, 1] - found[:, 0])
        at_b = np.arange(len(b)) + np.repeat(found[:, 1], found[:, 3] - found[:, 2])
        width = max(self.digits_a.shape[1], self.digits_b.shape[1])
        out = np.zeros((len(a) + len(b), width + 1), np.uint8)
        out[at_a, : self.digits_a.shape[1]], out[at_b, : self.digits_b.shape[1]] = self.digits_a[a], self.digits_b[b]
        out[:, width] = ord(",")
        out[at_a[found[:, 1] - 1], width], out[at_b[found[:, 3] - 1], width] = ord("|"), ord(";")
        last = at_b[bounds[:, 3] - 1]
        out[last, width] = 0
        ends = np.cumsum((out != 0).sum(axis=1))[last].tolist()
        text = out[out != 0].tobytes().decode()
        return [text[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def _pairs(self, a: np.ndarray, b: np.ndarray, found: np.ndarray, of: np.ndarray, links: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs per text: how many, the pairs, how often each is linked."""
        small = links <= SMALL
        f, sizes = found[small], links[small]
        k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = np.repeat(f[:, 3] - f[:, 2], sizes)
        keys = [np.repeat(of[small], sizes) << 40 | a[np.repeat(f[:, 0], sizes) + k // wide] * len(self.bytes_b) + b[np.repeat(f[:, 2], sizes) + k % wide]]
        amounts = [np.ones(len(k), np.int64)]
        for row, (a0, a1, b0, b1) in zip(of[~small], found[~small], strict=True):
            (xs, nx), (ys, ny) = np.unique(a[a0:a1], return_counts=True), np.unique(b[b0:b1], return_counts=True)
            keys.append((row << 40) | (xs[:, None] * len(self.bytes_b) + ys[None, :]).ravel())
            amounts.append((nx[:, None] * ny[None, :]).ravel())
        keys, amounts = added_up(np.concatenate(keys), np.concatenate(amounts))
        return np.bincount(keys >> 40, minlength=n), keys & ((1 << 40) - 1), amounts


def added_up(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their amounts."""
    order = np.argsort(keys, kind="stable")
    keys, amounts = keys[order], amounts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(amounts, first) if len(first) else amounts


def _links(aligner: Aligner, rows: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets per row, pairs and times of n rows that hold the known chunks `which` (one entry per occurrence)."""
    held, times = np.unique(rows << 32 | which, return_counts=True)
    row, chunk = held >> 32, held & 0xFFFFFFFF
    behind = np.cumsum(aligner.n_pairs.all)
    lengths = aligner.n_pairs.all[chunk]
    at = np.arange(lengths.sum()) + np.repeat(behind[chunk] - lengths - (np.cumsum(lengths) - lengths), lengths)
    keys, amounts = added_up(np.repeat(row, lengths) << 40 | aligner.pairs.all[at], np.repeat(times, lengths) * aligner.times.all[at])
    return np.searchsorted(keys >> 40, np.arange(n + 1)), keys & ((1 << 40) - 1), amounts


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Chunks per text (none without text), and all chunks."""
    odd = pc.fill_null(pc.match_substring_regex(texts, _NO_CUT), False)
    given = pc.and_(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False), pc.invert(odd))
    plain = pc.split_pattern(texts.filter(given), " ")
    sizes = np.zeros(len(texts), np.int64)
    sizes[given.to_numpy(zero_copy_only=False)] = pc.list_value_length(plain).to_numpy(zero_copy_only=False)
    if not pc.any(odd).as_py():
        return sizes, plain.flatten()
    parts, at, behind = [], 0, np.cumsum(sizes)
    flat = plain.flatten()
    for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
        own = chunks(texts[int(k)].as_py())
        parts += [flat[at : behind[k]], pa.array(own, flat.type)]
        at, sizes[k] = behind[k], len(own)
    return sizes, pa.concat_arrays([*parts, flat[at:]])


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links array<struct<pair: long, times: long>>"
_LINK = pa.struct([("pair", pa.int64()), ("times", pa.int64())])


def _batches(path_a: str, path_b: str, full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        aligner = Aligner(path_a, path_b)
        for part in (x for batch in batches for x in slices(batch, 1, SLICE)):
            if len(aligner.groups) > REMEMBERED[0] or aligner.characters + aligner.pairs.n > REMEMBERED[1]:
                aligner.forget()
            texts, n = part.column(1), part.num_rows
            sizes, flat = _cut(texts)
            coded = flat.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            aligner.learn([x for x in distinct if x not in aligner.number])
            numbers = np.fromiter(map(aligner.number.__getitem__, distinct), np.int64, len(distinct))
            which, rows = numbers[coded.indices.to_numpy()], np.repeat(np.arange(n), sizes)
            lost = np.unique(rows[aligner.counts["n_groups"].all[which] == 0])
            for k in lost:  # as a whole it may keep its bytes
                whole = texts[int(k)].as_py()
                if whole not in aligner.number:
                    aligner.learn([whole])
            if len(lost):
                whole = [aligner.number[texts[int(k)].as_py()] for k in lost]
                keep = ~np.isin(rows, lost)
                rows, which = np.append(rows[keep], lost), np.append(which[keep], whole)
                order = np.argsort(rows, kind="stable")
                rows, which = rows[order], which[order]
            behind = np.searchsorted(rows, np.arange(n + 1)).tolist()
            of = list(map(aligner.groups.__getitem__, which.tolist()))
            groups = [";".join(of[s:e]) if e > s and of[s] is not None else "" for s, e in zip(behind[:-1], behind[1:], strict=True)]
            offsets, pairs, times = _links(aligner, rows, which, n)
            columns = [
                part.column(0),
                *[pa.array(np.bincount(rows, aligner.counts[c].all[which], n).astype(np.int64)) for c in COUNTS],
                pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups], pa.string()),
                pa.array(groups if full else [None] * n, pa.string()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], fields=list(_LINK))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "groups_sha256", "groups", "links"])

    return run


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """SCHEMA for every row of docs: counts, the groups (null unless wanted) and their digest, and the distinct linked id pairs.

    A pair is the A id times B's number of ids, plus the B id. Null and empty texts, and texts whose
    bytes a tokenizer changes, have no tokens. Rows are independent; further columns are not read.
    """
    paths = default_paths()
    rows = spread(docs.select(F.col(id_col).cast("long"), F.col(text_col)))
    return rows.mapInArrow(_batches(path_a or paths[0], path_b or paths[1], with_groups), SCHEMA)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no other pair of its A id is in more) of all linked pairs."""
    counts = stored(aligned.select(F.inline("links")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    a = F.floor(F.col("pair") / size_b)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))  # a row per A id: bounded by the vocabulary
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs; cases as in align().

    Rows that repeat an id are documents of their own. An empty table gives an empty result.
    """
    paths = default_paths()
    path_a, path_b = path_a or paths[0], path_b or paths[1]
    size_b = len(tokenizers_of(path_a, path_b)[3])
    aligned = stored(align(docs, path_a, path_b).drop("groups").withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(aligned, size_b), "pair_counts")
    links = aligned.select("row", F.inline("links"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") * FREQUENT > total
    hot, rest = F.broadcast(counts.filter(frequent)), counts.filter(~frequent)
    met = links.join(hot, "pair").unionByName(links.join(F.broadcast(counts.filter(frequent).select("pair")), "pair", "left_anti").join(rest, "pair"))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("times")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    return aligned.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir, "doc_id", "text"))
