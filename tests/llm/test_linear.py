"""Licence scans of long notices, their base columns by a plain search, and family comparisons in small blocks."""

import random
import re
import time

from loomtrace.llm import license_scan, near_dedup, secret_scan


def spoiled(text, draw):
    i = draw.randrange(len(text))
    return text[:i] + draw.choice("abcxyz") + text[i + 1 :]


def test_notices_cost_their_length():
    draw = random.Random(1)
    text = " ".join(spoiled(draw.choice(list(license_scan.NOTICES)), draw) for _ in range(2000))
    scanner, took = license_scan.Scanner(), []
    for part in (text[: len(text) // 4], text):
        scanner.seen.clear()
        began = time.process_time()
        found = scanner.notices(part)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1 and len(found) > 1900  # four times the text
    began = time.process_time()
    assert len(license_scan.Scanner().notices("licensed under cc by nc " * 40_000)) == 40_000
    assert time.process_time() - began < 10


def test_of_overlapping_matches_the_better_one_stays():
    notice = "subject to the terms of the mozilla public license"
    poor = "subject to tbe terxs of the mozilla"
    found = [x for x in license_scan.Scanner().notices(f"a {poor} {notice} b") if x[0] == "mpl"]
    assert (found[-1][1:3], found[-1][3]) == ((3 + len(poor), 3 + len(poor) + len(notice)), 0)
    twice = license_scan.Scanner().notices(f"{notice} {notice}")
    assert [x[1:] for x in twice if x[0] == "mpl"] == [(0, len(notice), 0), (len(notice) + 1, 2 * len(notice) + 1, 0)]


def test_base_columns_equal_a_plain_search(spark):
    draw = random.Random(7)
    parts = ["MIT", "license", "Apache", "General", "Public", "License", "mit-license", "é", "general public", "licens", "1", "_"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", "\n", "  ", "-", ", ", ""]) for _ in range(draw.randrange(40))) for _ in range(120)] + [None, ""]
    wanted = []
    for text in texts:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        wanted.append((len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(license_scan.scan_licenses(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == wanted
    assert all(set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in got) and sum(w[1] for w in wanted) > 20


def test_family_comparisons_in_blocks_of_few_shingles(spark, monkeypatch):
    """A family of long and short texts; links within a bucket are the same whatever the size of a block."""
    draw = random.Random(3)
    sets = {i: sorted(draw.sample(range(60), draw.randrange(20, 60))) for i in range(30)}
    rows = [(b, i, i) for b in range(3) for i in sets if i % 3 == b or i % 5 == b]
    mixed = spark.createDataFrame(rows, "bucket long, id long, component long")
    table = spark.createDataFrame(list(sets.items()), "id long, set array<long>")
    found = []
    for size in (10**9, 150):
        monkeypatch.setattr(near_dedup, "BLOCK", size)
        links = {tuple(sorted(r)) for r in near_dedup.family_links(mixed, table).collect()}
        found.append(links)
    family = {i for _, i, _ in rows}
    linked = {(a, b) for a in family for b in family if a < b and 4 * len({*sets[a]} & {*sets[b]}) >= 3 * len({*sets[a]} | {*sets[b]})}
    assert found[0] == found[1] == linked and linked


def test_loud_lines_cost_their_length():
    draw = random.Random(5)
    model = secret_scan.trained()
    pairs = [f"{draw.choice(['width', 'row_id', 'size'])}{draw.randint(0, 99)}={draw.randint(0, 10**6)}" for _ in range(8000)]
    took = []
    for n in (2000, 8000):
        secret_scan._remembered.cache_clear()
        began = time.process_time()
        found = secret_scan.field_spans(" ".join(pairs[:n]), model, model.reach())
        took.append(time.process_time() - began)
        assert found == secret_scan.field_spans(" ".join(pairs[:n]), model, None)
    assert took[1] < 8 * took[0] + 1  # four times the line
    assert took[1] < 10


def test_remembered_descriptions_equal_fresh_ones():
    draw = random.Random(6)
    for _ in range(300):
        token = "".join(draw.choice("abXY09_-./+=@é") for _ in range(draw.randint(1, secret_scan.SHORT + 5)))
        for near in (False, True):
            assert secret_scan._remembered(token, near) == secret_scan.own_features(token, near) == secret_scan._remembered(token, near)
