"""Licence scans: exact phrases, and short notices with bounded errors.

A notice of n characters with at most k errors contains one of k + 1 pieces unchanged (pigeonhole).
Pieces are searched exactly; around each hit the regex library's fuzzy matching verifies the whole
notice within k errors and gives the span. Each hit has a window of the notice's length and k
characters either way, so that a text costs its length. Only texts with a seed are looked at more closely.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import documents, slices, spread

#: Fixed by the contract: phrases (as words) and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices of common licences, as lower-case words joined by single blanks, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: One error is allowed for so many characters of a notice.
CHARS_PER_ERROR = 12

#: Windows whose best match a worker remembers; beyond that it starts anew.
REMEMBERED = 20_000

#: Lower-cases A-Z and turns every byte outside of words into a blank.
_PLAIN = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else b + 0x20 if 0x41 <= b < 0x5B else 0x20 for b in range(256))


def _errors(notice: str) -> int:
    return len(notice) // CHARS_PER_ERROR


def seeds(notice: str) -> list[tuple[int, str]]:
    """The k + 1 pieces of a notice with their places; at k errors or fewer one of them is unchanged."""
    k = _errors(notice)
    edges = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Scanner:
    """Searches normalised texts (lower-case words joined by single blanks)."""

    def __init__(self, notices: dict[str, str] = NOTICES):
        import ahocorasick

        self.labels = list(notices.items())
        self.find = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, _) in enumerate(self.labels):
            for at, piece in seeds(notice):
                places.setdefault(piece, []).append((n, at))
        for piece, where in places.items():
            self.find.add_word(piece, (len(piece), where))
        self.find.make_automaton()
        self.seeds = sorted(places)
        self.seen: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={_errors(notice)}}}") for notice, _ in self.labels]

    def notices(self, text: str) -> list[tuple[str, int, int, int]]:
        """label, start, end, errors of the notices in a normalised text."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for last, (length, where) in self.find.iter(text):
            first = last - length + 1
            for n, at in where:
                own = found.setdefault(n, [])
                if own and own[-1][0] <= first and last < own[-1][1]:
                    continue  # a piece of the match before
                k, size = _errors(self.labels[n][0]), len(self.labels[n][0])
                start = max(0, first - at - k)
                m = self.best(n, text[start : first - at + size + k])
                if m is None:
                    continue
                a, b, e = start + m[0], start + m[1], m[2]
                if own and a < own[-1][1]:  # of two that overlap the better one stays
                    if e >= own[-1][2]:
                        continue
                    own.pop()
                own.append((a, b, e))
        return sorted(((self.labels[n][1], *x) for n, own in found.items() for x in own), key=lambda x: (x[1], x[2], x[0]))

    def best(self, n: int, window: str) -> tuple[int, int, int] | None:
        """start, end, errors of a notice's best match in a window around a piece; windows seen before are looked up."""
        key = n, window
        if key not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            m = self.fuzzy[n].search(window)
            self.seen[key] = (m.start(), m.end(), sum(m.fuzzy_counts)) if m and m.end() > m.start() else None
        return self.seen[key]


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Word index and label of each place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in PHRASES.items():
        own = [w.encode() for w in phrase.split()]
        last = -1
        while True:
            try:
                last = words.index(own[-1], last + 1)
            except ValueError:
                break
            if last + 1 >= len(own) and words[last + 1 - len(own) : last + 1] == own:
                found.append((last + 1 - len(own), label))
    return sorted(found)


SCHEMA = "row long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,last:int,errors:int>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("errors", pa.int32())]))


def _scan(notices: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(scanner: Scanner, words: list[bytes], text: str) -> tuple:
        places = phrase_places(words)
        fuzzy = scanner.notices(text)
        base = sorted({label for _, label in places})
        every = sorted({*base, *(x[0] for x in fuzzy)})
        best = 1.0 if places else max((1 - e / max(1, b - a) for _, a, b, e in fuzzy), default=0.0)
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32) if fuzzy else None
        index = lambda at: int(np.searchsorted(blanks, at))
        spans = [{"label": x, "first": index(a + (text[a : a + 1] == " ")), "last": index(b - (text[b - 1 : b] == " ")), "errors": e} for x, a, b, e in fuzzy]
        return len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(every), best, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        needed = [b"license", *(x.encode() for x in scanner.seeds)]
        none = (0, None, None, "", "", 0.0, [])
        for batch in (x for whole in batches for x in slices(whole)):
            n_words, rows = [], []
            for x in batch.column(1).to_pylist():
                words = (x or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()
                plain = b" ".join(words)
                n_words.append(len(words))
                # without a phrase's last word and without a seed there is nothing to find
                rows.append(one(scanner, words, plain.decode("utf-8", "surrogatepass")) if any(y in plain for y in needed) else none)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                ["row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return run


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrases and fuzzy notices of every row of docs; spans are word ranges with their errors.

    score is 1 with a phrase, else the best notice's share of unchanged characters, else 0. Null and
    empty texts have no words; rows are independent of each other; further columns are not read.
    """
    rows = spread(docs.select(F.col(id_col).cast("long"), F.col(text_col)))
    return rows.mapInArrow(_scan(notices or NOTICES), SCHEMA).withColumnRenamed("row", "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text")).drop("spans")
