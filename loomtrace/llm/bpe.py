"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks file lists byte strings. The library works on characters, so each byte is mapped to a
printable character (the usual byte-level table); every pair of vocabulary entries whose
concatenation is an entry becomes a merge, in the order of the concatenation's rank, which makes the
library merge as a rank-based encoder does; entries that are whole words are taken as they are.
Decoding reverses the byte table on the concatenated entries, so that characters split over several
ids come out whole.

A text is split by the pattern first (the regex module, the same Unicode classes); each distinct
piece goes through the library once per worker and is then looked up. Pieces are encoded separately
by contract, so ids and offsets are those of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import documents, slices, spread

#: Bytes of text that a worker splits and encodes at a time (a text at least).
SLICE = 500_000
#: Characters and ids of distinct pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 1_500_000


def byte_table() -> list[str]:
    """The character for each byte: printable Latin-1 characters stand for themselves, others for U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer for a ranks file; it encodes one piece at a time."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    known, table = ranks(path), byte_table()
    chars = {token: "".join(table[b] for b in token) for token in sorted(known, key=known.__getitem__)}
    merges = [(chars[t[:i]], chars[t[i:]]) for t in chars for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
    bpe = Tokenizer(models.BPE(vocab={c: known[t] for t, c in chars.items()}, merges=merges, ignore_merges=True))
    bpe.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return bpe


@lru_cache(maxsize=2)
def _id_bytes(path: str) -> list[bytes]:
    """The bytes of each id: its characters through the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_table())}
    vocab = tokenizer(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for chars, i in vocab.items():
        out[i] = bytes(back[c] for c in chars)
    return out


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    """The bytes that ids stand for; concatenating first keeps characters whole that ids split."""
    return b"".join(map(_id_bytes(path).__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def splitter(pattern: str) -> regex.Pattern:
    r"""The pattern with \s as the Unicode property White_Space, as the encoders read it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Pieces:
    """Encodings of distinct pieces: the bytes of their ids (unsigned 32-bit), and offsets if wanted."""

    def __init__(self, path: str, offsets: bool):
        self.bpe, self.offsets, self.ids, self.spans, self.held = tokenizer(path), offsets, {}, {}, 0

    def learn(self, pieces: set[str]) -> None:
        if self.held > REMEMBERED:
            self.ids, self.spans, self.held = {}, {}, 0
        new = [x for x in pieces if x not in self.ids]
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            encoded = (self.bpe.encode_batch if self.offsets else self.bpe.encode_batch_fast)(part, add_special_tokens=False)
            for x, e in zip(part, encoded, strict=True):
                self.ids[x] = np.array(e.ids, "<u4").tobytes()
                self.held += len(x) + len(e.ids)
                if self.offsets:
                    self.spans[x] = e.offsets


def _batches(path: str, pattern: str, full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        known, split = Pieces(path, full), splitter(pattern)
        for part in (x for batch in batches for x in slices(batch, 1, SLICE)):
            parts = [split.findall(x or "") for x in part.column(1).to_pylist()]
            known.learn(set().union(*parts))
            raw = [b"".join(map(known.ids.__getitem__, x)) for x in parts]
            ids = [np.frombuffer(x, "<u4") for x in raw]
            columns = {
                "row": part.column(0),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(decode_bytes(x, path)).hexdigest() for x in ids], pa.string()),
            }
            if full:
                spans = [
                    [(m + a, m + b) for m, x in zip(accumulate(map(len, xs), initial=0), xs, strict=False) for a, b in known.spans[x]] for xs in parts
                ]
                columns["ids"] = pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32()))
                columns["starts"] = pa.array([[a for a, _ in x] for x in spans], pa.list_(pa.int32()))
                columns["ends"] = pa.array([[b for _, b in x] for x in spans], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids, starts, ends for every row of docs.

    starts and ends are the character offsets of each id in its text. Null and empty texts have no
    ids. Rows are independent of each other; further columns are not read.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    schema = "row long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, starts array<int>, ends array<int>"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(_batches(path, pattern, True), schema).withColumnRenamed("row", "doc_id")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode, without ids and offsets."""
    path, pattern = path or default_path(), pattern or default_pattern()
    rows = spread(docs.select(F.col(id_col).cast("long"), F.col(text_col)))
    return (
        rows
        .mapInArrow(_batches(path, pattern, False), "row long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .withColumnRenamed("row", "doc_id")
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"))
