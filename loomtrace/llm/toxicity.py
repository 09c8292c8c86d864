"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers are composed into one machine that reads the clauses of a text. Their symbols
are word classes: insult, threat, target, negation, report, and word for all others. The lexicon gives
insults their weights: its arcs are whole words and word beginnings (so that inflected forms are
caught), learned from labelled rows. An arc of a transducer reads a symbol, writes one, and has a gain:

- negation: after a negation, insults and threats of the next words count for less;
- report: after a reporting verb, so do those of the rest of the clause;
- target: insults and threats near a target, before or after it, are aimed;
- threat: only aimed threats count;
- insult: aimed insults count for more.

Whether a target will follow is guessed (the target machine isn't deterministic), and a path with a
wrong guess never ends in a final state. A clause scores the most that a path through the composed
machine gathers: each word's weight times the gains of the arcs that read it. A text's figures (sum and
maximum of its clauses' scores, insults a word) go through a logistic regression, also learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import documents, slices, spread

#: Rows the classifier is fitted on: at most so many of either label, in the order of a hash of their ids.
SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 12_000
#: Beginnings of words that may be lexicon arcs, by length.
STEMS = (4, 5, 6, 7)
#: Most lexicon arcs that are kept.
ARCS = 4_000
#: Words whose weights a worker remembers; beyond that it starts anew.
REMEMBERED = 50_000
THRESHOLD = 0.3

TARGETS = frozenset("you your yours he him his she her they them their tu te vous ton ta él ella usted ustedes du dich dir ihr sie".split())
THREATS = frozenset("kill hurt destroy attack beat stab shoot burn murder tuer matar töten schlagen".split())
NEGATIONS = frozenset("not no never nobody isn wasn aren don doesn non pas jamais nunca jamás kein keine nicht nie".split())
REPORTS = frozenset("said says wrote quoted claimed reported called told dit écrit dijo escribió sagte schrieb".split())

#: Gains of negated, reported and aimed words; how many words a negation and a target reach; the weight of an aimed threat.
NEGATED, REPORTED, AIMED = 0.25, 0.5, 1.5
NEGATION_REACH, TARGET_REACH = 4, 5
THREAT_WEIGHT = 3.0

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = ("word", "target", "threat", "negation", "report", "insult")
MARKED = ("insult", "threat")


@dataclass
class Transducer:
    """arcs: state and symbol read to arcs (symbol written, gain, next state); a pair without arcs is a dead end."""

    start: object
    arcs: dict[tuple, list[tuple[str, float, object]]]
    final: set

    def paths(self, symbols: list[str]) -> list[tuple[list[str], list[float]]]:
        """What every accepting path writes, and its gains (all of them; for tests and short inputs)."""
        found = [(self.start, [], [])]
        for x in symbols:
            found = [(t, [*out, y], [*gains, g]) for s, out, gains in found for y, g, t in self.arcs.get((s, x), ())]
        return [(out, gains) for s, out, gains in found if s in self.final]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """b reads what a writes; gains are multiplied. States are the pairs that can be reached."""
    read_by_a = {}
    for (s, x), arcs in a.arcs.items():
        read_by_a.setdefault(s, []).append((x, arcs))
    start = (a.start, b.start)
    todo, seen, joined = [start], {start}, {}
    while todo:
        s, t = state = todo.pop()
        for x, arcs in read_by_a.get(s, ()):
            made = [(z, g * h, (s2, t2)) for y, g, s2 in arcs for z, h, t2 in b.arcs.get((t, y), ())]
            if made:
                joined[state, x] = made
                fresh = {n for *_, n in made} - seen
                seen |= fresh
                todo += fresh
    return Transducer(start, joined, {(s, t) for s, t in seen if s in a.final and t in b.final})


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """The state counts the words left in the scope of a negation."""
    arcs = {}
    for left in range(reach + 1):
        for x in SYMBOLS:
            gain = NEGATED if left and x in MARKED else 1.0
            arcs[left, x] = [(x, gain, reach if x == "negation" else max(0, left - 1))]
    return Transducer(0, arcs, set(range(reach + 1)))


def report() -> Transducer:
    """State 1: what follows is somebody's speech, up to the clause's end."""
    arcs = {(s, x): [(x, REPORTED if s and x in MARKED else 1.0, int(s or x == "report"))] for s in (0, 1) for x in SYMBOLS}
    return Transducer(0, arcs, {0, 1})


def target(reach: int = TARGET_REACH) -> Transducer:
    """States: (seen, k), a target lies back and reaches k more words (0: none); (owed, k), one must follow within k words."""
    arcs = {}
    for k in range(reach + 1):
        for x in SYMBOLS:
            on = ("seen", reach) if x == "target" else ("seen", max(0, k - 1))
            if x not in MARKED:
                arcs[("seen", k), x] = [(x, 1.0, on)]
            elif k:
                arcs[("seen", k), x] = [("aimed " + x, 1.0, on)]
            else:  # not aimed, or a target follows
                arcs[("seen", 0), x] = [(x, 1.0, ("seen", 0)), ("aimed " + x, 1.0, ("owed", reach))]
    for k in range(1, reach + 1):
        for x in SYMBOLS:
            if x == "target":
                arcs[("owed", k), x] = [(x, 1.0, ("seen", reach))]
            elif k > 1:
                arcs[("owed", k), x] = [("aimed " + x if x in MARKED else x, 1.0, ("owed", k - 1))]
    return Transducer(("seen", 0), arcs, {("seen", k) for k in range(reach + 1)})


def _single(gains: dict[str, tuple[str, float]]) -> Transducer:
    """One state; symbols that gains doesn't name pass."""
    passed = {x: (x, 1.0) for x in (*SYMBOLS, *("aimed " + x for x in MARKED))} | gains
    return Transducer(0, {(0, x): [(y, g, 0)] for x, (y, g) in passed.items()}, {0})


def threat() -> Transducer:
    return _single({"threat": ("word", 0.0), "aimed threat": ("threat", 1.0)})


def insult() -> Transducer:
    return _single({"aimed insult": ("insult", AIMED)})


def cascade() -> list[Transducer]:
    return [negation(), report(), target(), threat(), insult()]


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    """The composed machine, with its states numbered."""
    whole = reduce(compose, cascade())
    number = {s: i for i, s in enumerate({whole.start: 0} | {s: 0 for s, _ in whole.arcs} | {n: 0 for arcs in whole.arcs.values() for *_, n in arcs})}
    arcs = {(number[s], x): [(y, g, number[n]) for y, g, n in found] for (s, x), found in whole.arcs.items()}
    return Transducer(number[whole.start], arcs, {number[s] for s in whole.final if s in number})


def clause_score(clause: list[tuple[str, float]], machine: Transducer) -> float:
    """The most that an accepting path gathers from (symbol, weight) pairs."""
    best = {machine.start: 0.0}
    for symbol, weight in clause:
        ahead: dict = {}
        for state, so_far in best.items():
            for _, gain, n in machine.arcs.get((state, symbol), ()):
                value = so_far + gain * weight
                if value > ahead.get(n, -1.0):
                    ahead[n] = value
        best = ahead
    return max((v for s, v in best.items() if s in machine.final), default=0.0)


class Lexicon:
    """Learned arcs: whole words and word beginnings with weights."""

    def __init__(self, arcs: dict[str, float]):
        self.arcs, self.known = arcs, {}

    def weight(self, word: str) -> float:
        """The weight of the heaviest arc that accepts a lower-case word; 0 without one."""
        found = self.known.get(word)
        if found is None:
            found = max((self.arcs[x] for x in units(word) if x in self.arcs), default=0.0)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def classify(self, word: str) -> tuple[str, float]:
        w = self.weight(word)
        if w > 0:
            return "insult", w
        if word in THREATS:
            return "threat", THREAT_WEIGHT
        return ("negation" if word in NEGATIONS else "report" if word in REPORTS else "target" if word in TARGETS else "word"), 0.0

    def figures(self, text: str) -> tuple[float, float, float]:
        """Sum and maximum of the clauses' scores, and the insults' share of the words; zeros without an insult or a threat."""
        low = text.lower()
        words = WORD.findall(low)
        marked = {w for w in set(words) if w in THREATS or self.weight(w)}
        if not marked:
            return 0.0, 0.0, 0.0
        scores, hits, clause, machine = [], 0, [], grammar()
        for token in [*TOKEN.findall(low), "."]:
            if token not in ".!?;:\n":
                clause.append(token)
            elif clause:
                if not marked.isdisjoint(clause):  # others score nothing
                    read = [self.classify(w) for w in clause]
                    hits += sum(kind == "insult" for kind, _ in read)
                    scores.append(clause_score(read, machine))
                clause = []
        return float(sum(scores)), float(max(scores, default=0.0)), hits / max(1, len(words))


def units(word: str) -> list[str]:
    """What may accept a word: itself, and its beginnings (marked by *)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, half of the bounded sample; half says which step learns from a row."""
    usable = (
        labels
        .filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    )
    order = [F.md5(F.col("_id").cast("string")), F.col("_id")]
    sample = (
        usable
        .filter("toxic = 1")
        .orderBy(*order)
        .limit(SAMPLE_TOXIC)
        .unionByName(usable.filter("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).drop("_id")  # bounded by the sample sizes
    return joined.withColumn("half", (F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string")).cast("binary")) % 3 == 0).cast("int"))


def _distinct(rows: DataFrame) -> DataFrame:
    """Rows (text, toxic) of which those equal but for case and white space, and of one label, are one."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    return rows.select(text.alias("text"), "toxic").distinct()


def _unit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each unit, by label."""
    counts: dict[tuple[str, int], int] = Counter()
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = set(WORD.findall((text or "").lower()))
            counts.update((u, toxic) for u in {u for w in words for u in units(w)})
            counts[("", toxic)] += 1
    yield pd.DataFrame([(u, n if t else 0, 0 if t else n) for (u, t), n in counts.items()], columns=["unit", "toxic", "clean"])


def fit_lexicon(rows: DataFrame) -> Lexicon:
    """Arcs with their log odds from rows (text, toxic); copies of one label count once.

    An arc is at least 20 times likelier in toxic documents, found in 3 and 1 % of them, and its
    likelihood ratio pays for the number of units tried, so that small samples give few false arcs.
    """
    counts = (
        _distinct(rows)
        .mapInPandas(_unit_counts, "unit string, toxic long, clean long")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .persist()
    )
    of_all = lambda c: F.coalesce(F.max(F.when(F.col("unit") == "", F.col(c))), F.lit(0))
    n_units, n_toxic, n_clean = counts.agg(F.count(F.lit(1)), F.greatest(of_all("toxic"), F.lit(1)), F.greatest(of_all("clean"), F.lit(1))).first()
    share = n_toxic / (n_toxic + n_clean)
    both = F.col("toxic") + F.col("clean")
    ratio = (
        F.col("toxic") * F.log(F.col("toxic") / (both * share))
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0)
    )
    odds = F.log(((F.col("toxic") + 0.1) / (n_toxic + 0.2)) / ((F.col("clean") + 0.1) / (n_clean + 0.2)))
    kept = (
        counts
        .filter(f"unit <> '' and toxic >= {max(3, n_toxic // 100)}")
        .withColumn("weight", odds)
        .filter((F.col("weight") >= float(np.log(20.0))) & (ratio >= float(np.log(max(2, n_units)))))
    )
    top = kept.orderBy(F.desc("toxic"), F.desc("weight"), "unit").limit(ARCS).collect()  # bounded by ARCS
    counts.unpersist()
    return Lexicon({r["unit"]: float(r["weight"]) for r in top})


def design(figures: np.ndarray) -> np.ndarray:
    """The regression's inputs: a constant, whether there is an insult, squashed sum, maximum and share."""
    figures = figures.reshape(-1, 3)
    return (
        np
        .column_stack([np.ones(len(figures)), figures[:, 0] > 0, np.log1p(figures[:, 0]), np.log1p(figures[:, 1]), np.log1p(100 * figures[:, 2])])
        .astype(float)
    )


def fit_regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = design(np.array([self.lexicon.figures(t or "") for t in texts], float))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model fitted on the bounded sample of labelled rows; without labels it scores every text 0.5."""
    rows = training_rows(docs, labels).persist()
    try:
        lexicon = fit_lexicon(rows.filter("half = 0"))

        def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = np.array([lexicon.figures(t or "") for t in batch["text"]], float).reshape(-1, 3)
                yield pd.DataFrame({"a": out[:, 0], "b": out[:, 1], "c": out[:, 2], "toxic": batch["toxic"].to_numpy()})

        own = rows.filter("half = 1").mapInPandas(figures, "a double, b double, c double, toxic int").toPandas()  # bounded by the sample
    finally:
        rows.unpersist()
    own = own.sort_values(["a", "b", "c", "toxic"])  # sums must not depend on the order of arrival
    return Model(lexicon, fit_regression(design(own[["a", "b", "c"]].to_numpy(float)), own["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row of docs.

    Null and empty texts score what a text without insults scores; rows are independent of each
    other; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole)):
            s = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                ["row", "score", "predicted"],
            )

    rows = spread(docs.select(F.col(id_col).cast("long"), F.col(text_col)))
    return rows.mapInArrow(run, "row long, score double, predicted int").withColumnRenamed("row", "doc_id")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject; cases as in score(): null and empty texts stay, repeated rows fare alike."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, whole.schema.get_field_index("text"))):
            yield batch.filter(pa.array(model.scores(batch.column("text").to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
