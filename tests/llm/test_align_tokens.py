"""Cross-tokenizer alignment against brute force: encodings of whole texts and sets of ends."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomtrace.llm import align_tokens
from loomtrace.llm.bpe import byte_table

SCHEMA = "doc_id long, text string"


def brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: i for i, c in enumerate(byte_table())}
    found = []
    for doc_id, text in rows:
        encoded, ids_b = a.encode(f" {text}", add_special_tokens=False), b.encode(text or "")
        raw_a = [bytes(back[c] for c in t) for t in encoded.tokens]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == f" {text}".encode() == b"".join(raw_b):
            found.append((doc_id, [], [], []))
            continue
        ends_a, ends_b = list(accumulate(map(len, raw_a))), list(accumulate(map(len, raw_b)))
        at, groups = (0, 0), []
        for end in sorted(set(ends_a) & set(ends_b)):
            to = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((encoded.ids[at[0] : to[0]], ids_b[at[1] : to[1]]))
            at = to
        found.append((doc_id, encoded.ids, ids_b, groups))
    links = [[(x, y) for xs, ys in groups for x in xs for y in ys] for *_, groups in found]
    counts = Counter(pair for one in links for pair in set(one))
    highest = Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, ids_a, ids_b, groups), one in zip(found, links, strict=True):
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        n_best = sum(counts[p] == highest[p[0]] for p in one)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(one), n_best, sum(counts[p] for p in one), digest))
    return sorted(out, key=repr)


def aligned(spark, rows):
    return sorted((tuple(r) for r in align_tokens.alignment(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


ODD = [
    "", None, " ", "  two  spaces ", "\n \n a", "a\n b\t c", "tab\t x　 y", "　　 a", "日本語のテキスト です 🎉🎉", "<|endoftext|> a <s> <0x41>",
    "\x00 a", "aaaa" * 300 + " " + "1" * 400, "don't it's", "é́   x", "a ▁", "▁ a b", "x ▁ y", "﻿ hi", "\x1c \x1f x", "a▁b c", "word, word; word",
]


def test_odd_texts_repeated_ids_and_nulls(spark):
    rows = [*enumerate(ODD), (3, "an id again"), (None, "word, word"), (3, "an id again")]
    assert aligned(spark, rows) == brute(rows)


def test_documents_of_many_languages(spark):
    words = ["plum", "Zwetschge", "prune,", "слива", "梅の木", "plum-tree", "3.14159", "http://a.b/c?d=e", "naïve", "…", "🎉", "x" * 30]
    draw = random.Random(4)
    rows = [(i, draw.choice([" ", "  ", "\n"]).join(draw.choices(words, k=draw.randrange(1, 60)))) for i in range(60)]
    assert aligned(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert aligned(spark, []) == []
    docs = spark.createDataFrame([(1, "plum tree", 7, "x")], "doc_id long, text string, row long, pair string")
    assert [tuple(r) for r in align_tokens.alignment(docs).collect()] == brute([(1, "plum tree")])


def test_pairs_that_are_not_frequent_join_alike(spark, monkeypatch):
    rows = [(i, f"plum {i} tree {i % 3}") for i in range(40)]
    monkeypatch.setattr(align_tokens, "FREQUENT", 10)
    assert aligned(spark, rows) == brute(rows)


def test_forgetting_and_large_groups_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(align_tokens, "SMALL", 1)
    aligner = align_tokens.Aligner(*align_tokens.default_paths())
    aligner.learn(["plum-tree", "naïve🎉"])
    few = aligner.pairs.all.tolist(), aligner.times.all.tolist(), list(aligner.groups)
    monkeypatch.undo()
    aligner.forget()
    aligner.learn(["plum-tree", "naïve🎉"])
    assert few == (aligner.pairs.all.tolist(), aligner.times.all.tolist(), list(aligner.groups))


@pytest.mark.parametrize("tries", [1, 16])
def test_shared_cuts_equal_sets_of_ends(monkeypatch, tries):
    monkeypatch.setattr(align_tokens, "TRIES", tries)
    draw = random.Random(9)
    for _ in range(200):
        last = draw.randrange(1, 80)
        a, b = ([*sorted(draw.sample(range(1, last), draw.randrange(last))), last] for _ in range(2))
        found = align_tokens.shared_cuts(np.array(a), np.array(b), np.array([[0, len(a), 0, len(b)]]))
        ends = sorted(set(a) & set(b))
        assert [(a[a1 - 1], b[b1 - 1]) for _, a1, _, b1 in found.tolist()] == [(e, e) for e in ends]
        assert [(a0, b0) for a0, _, b0, _ in found.tolist()] == [(0, 0), *[(a.index(e) + 1, b.index(e) + 1) for e in ends[:-1]]]


def test_a_long_stretch_without_a_shared_cut():
    a, b = np.append(np.arange(1, 40_001, 2), 40_001), np.append(np.arange(2, 40_001, 2), 40_001)
    found = align_tokens.shared_cuts(a, b, np.array([[0, len(a), 0, len(b)]]))
    assert found.tolist() == [[0, len(a), 0, len(b)]]
