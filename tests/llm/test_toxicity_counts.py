"""The lexicon is learned from every labelled row, whatever words the rows share and however they are dealt out."""

import zlib

from loomtrace.llm import toxicity

#: Words of the texts; the one with the least hash stands in each text.
POOL = sorted(("".join(chr(97 + (i // 26**k) % 26) for k in range(3)) + "q" for i in range(2000)), key=lambda w: zlib.crc32(w.encode()))


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, toxic int")


def test_rows_with_a_common_word_all_count(spark):
    rows = [(" ".join([POOL[0], *(POOL[1 + (7 * i + 13 * k) % 1900] for k in range(18)), *(["grobnar"] if i % 2 else [])]), i % 2) for i in range(80)]
    assert "grobnar" in toxicity.fit_lexicon(table(spark, rows)).arcs
    found = [toxicity.fit_lexicon(table(spark, own).repartition(n)).arcs for own in (rows, rows[::-1]) for n in (1, 3)]
    assert all(x == found[0] for x in found)


def test_copies_count_once_and_labels_apart(spark):
    rows = [("You  GROB\n", 1), ("you grob", 1), (" you grob", 0), (None, 0), ("", 0)]
    assert sorted(map(tuple, toxicity._distinct(table(spark, rows)).collect())) == [("", 0), ("you grob", 0), ("you grob", 1)]
