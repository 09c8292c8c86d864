"""Quality rules by weak supervision, with Spark functions alone.

Every rule votes good (1), bad (-1) or abstains (0), and abstains unless it sees evidence. A rule has
four unknown rates: how often it votes bad or good on good documents, and on bad ones. The posterior
odds of a document are the prior odds times the ratio of rates of each vote cast. Expectation
maximisation estimates prior and rates from the counts of vote patterns, of which there are at most 3
to the number of rules, whatever the size of the corpus: one aggregation with map-side combining,
then a fold over iterations on that bounded table. No label is read.

Repeated three-word windows are found inside a text's own row by sorting 64-bit window hashes, so a
very long text costs n log n and nothing is shuffled but one narrow row a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import documents, stored, words

ITERATIONS = 10
#: Rates and the prior stay within these bounds, so that no single vote decides alone.
RATE, PRIOR = (0.01, 0.99), (0.05, 0.95)
#: Where the iteration starts: the prior, and a rule's rates; the start also counts as SMOOTHING documents of either kind.
START_PRIOR, SMOOTHING = 0.7, 20.0
START = {"bad_of_bad": 0.4, "good_of_bad": 0.2, "bad_of_good": 0.05, "good_of_good": 0.5}
THRESHOLD = 0.5

#: name, bad condition, good condition ("false": the rule never votes good); columns are the counts of features(). Integers only.
RULES = (
    ("symbols", "10 * n_symbols > n_words", "false"),
    ("sentences", "100 * n_marks < 2 * n_words or 3 * n_marks > n_words", "100 * n_marks >= 4 * n_words and 4 * n_marks <= n_words"),
    ("function words", "100 * n_short < 8 * n_words", "100 * n_short >= 15 * n_words and 100 * n_short <= 60 * n_words"),
    ("capitals", "100 * n_capitals > 30 * word_chars", "false"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "false"),
    ("duplicate lines", "4 * n_dup_lines > n_lines", "false"),
    ("vocabulary", "100 * n_distinct < 25 * n_words", "100 * n_distinct >= 40 * n_words and 100 * n_distinct <= 95 * n_words"),
    ("word length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars >= 4 * n_words and word_chars <= 7 * n_words"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct", "n_short")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array ws, the first occurrence included."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda e, k: (F.get(ordered, k - 1)["h"] == e["h"]) | (F.get(ordered, k + 1)["h"] == e["h"]))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def windows(a: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)))
        return let(
            hashes,
            lambda h: (
                F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
                .otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated))
            ),
        )

    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(let(ws, windows))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at, a row per row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("ws", words(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    glued = F.array_join("ws", "")
    counts = {
        "n_words": F.size("ws"),
        "word_chars": F.length(glued),
        "n_symbols": F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeat_words(F.col("ws")),
        "n_lines": F.size("lines"),
        "n_capitals": F.length("text") - F.length(F.regexp_replace("text", r"[A-Z]+", "")),
        "n_marks": F.size(F.filter("ws", lambda x: x.endswith(".") | x.endswith("!") | x.endswith("?"))),
        "n_distinct": F.size(F.array_distinct("ws")),
        "n_short": F.size(F.filter("ws", lambda x: x.rlike(r"^\p{L}{1,3}$"))),
    }
    return rows.select("doc_id", *[counts[c].cast("long").alias(c) for c in COUNTS])


def pattern() -> Column:
    """The votes of all rules as digits 0 (bad), 1 (abstains), 2 (good) of a base-3 number."""
    votes = [F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) for _, bad, good in RULES]
    return sum((v * 3**j for j, v in enumerate(votes)), F.lit(0)).cast("long")


def vote(p: Column, j: int) -> Column:
    return (F.floor(p / 3**j).cast("long") % 3 - 1).cast("int")


def posteriors(patterns: DataFrame) -> DataFrame:
    """pattern and posterior from rows (pattern); at most 3 ** len(RULES) rows."""
    counted = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    votes = F.array(*[vote(F.col("pattern"), j) for j in range(len(RULES))])
    table = counted.agg(F.sort_array(F.collect_list(F.struct("pattern", F.col("n").cast("double").alias("n"), votes.alias("v")))).alias("t"))

    def add(terms: Column) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    def within(x: Column, bounds: tuple[float, float]) -> Column:
        return F.least(F.lit(bounds[1]), F.greatest(F.lit(bounds[0]), x))

    def posterior(v: Column, state: Column) -> Column:
        ratio = (
            lambda x, r: F
            .when(x < 0, F.log(r["bad_of_good"] / r["bad_of_bad"]))
            .when(x > 0, F.log(r["good_of_good"] / r["good_of_bad"]))
            .otherwise(0.0)
        )
        return 1 / (1 + F.exp(-(F.log(state["prior"] / (1 - state["prior"])) + add(F.zip_with(v, state["rates"], ratio)))))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform("t", lambda e: F.struct(e["v"].alias("v"), (e["n"] * posterior(e["v"], state)).alias("good"), e["n"].alias("n")))

        def update(w: Column) -> Column:
            n, good = add(F.transform(w, lambda e: e["n"])), add(F.transform(w, lambda e: e["good"]))

            def rates(j: Column) -> Column:
                def rate(kind: str) -> Column:
                    of = (lambda e: e["good"]) if kind.endswith("good") else (lambda e: e["n"] - e["good"])
                    cast = add(F.transform(w, lambda e: F.when(F.get(e["v"], j) == (-1 if kind.startswith("bad") else 1), of(e)).otherwise(0.0)))
                    return within((cast + SMOOTHING * START[kind]) / ((good if kind.endswith("good") else n - good) + SMOOTHING), RATE).alias(kind)

                return F.struct(*map(rate, START))

            return F.struct(within(good / n, PRIOR).alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), rates).alias("rates"))

        return let(weighed, update)

    start = F.struct(
        F.lit(START_PRIOR).alias("prior"),
        F.array_repeat(F.struct(*[F.lit(x).alias(k) for k, x in START.items()]), len(RULES)).alias("rates"),
    )
    fitted = table.withColumn("state", F.when(F.size("t") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, step)))
    return (
        fitted
        .select("state", F.explode("t").alias("e"))
        .select(F.col("e.pattern").alias("pattern"), posterior(F.col("e.v"), F.col("state")).alias("posterior"))
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, posterior, kept for every row of docs.

    Null and empty texts have no words and fail the base. Repeated rows are judged alike, each on
    its own. An empty table gives an empty result; further columns are not read.
    """
    rows = stored(features(docs).withColumn("pattern", pattern()), "features")
    judged = rows.join(F.broadcast(stored(posteriors(rows.select("pattern")), "posteriors")), "pattern")  # bounded by 3 ** rules
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *COUNTS, failed.alias("base_failed"), "posterior", (~failed & (F.col("posterior") >= THRESHOLD)).alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def _sql() -> str:
    n = len(RULES)
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (_, bad, good) in enumerate(RULES))
    keys = ", ".join(f"v{j}" for j in range(n))
    ratio = " + CASE p.v{0} WHEN -1 THEN ln(s.bad_of_good{0} / s.bad_of_bad{0}) WHEN 1 THEN ln(s.good_of_good{0} / s.good_of_bad{0}) ELSE 0 END"
    odds = "ln(s.prior / (1 - s.prior))" + "".join(ratio.format(j) for j in range(n))
    steps = [
        f"it0 AS (SELECT {START_PRIOR}::DOUBLE AS prior, " + ", ".join(f"{x}::DOUBLE AS {k}{j}" for j in range(n) for k, x in START.items()) + ")"
    ]
    within = "least({1}, greatest({0}, {2}))"

    def rate(kind: str, j: int) -> str:
        q = "q" if kind.endswith("good") else "1 - q"
        cast = f"sum(n * CASE WHEN v{j} = {-1 if kind.startswith('bad') else 1} THEN {q} ELSE 0 END)"
        return within.format(*RATE, f"({cast} + {SMOOTHING * START[kind]}) / (sum(n * ({q})) + {SMOOTHING})") + f" AS {kind}{j}"

    for k in range(ITERATIONS):
        rates = ", ".join(rate(kind, j) for j in range(n) for kind in START)
        weighed = f"SELECT p.*, 1 / (1 + exp(-({odds}))) AS q FROM patterns p, it{k} s"
        steps.append(f"it{k + 1} AS (SELECT {within.format(*PRIOR, 'sum(n * q) / sum(n)')} AS prior, {rates} FROM ({weighed}))")
    same = " AND ".join(f"r.v{j} = p.v{j}" for j in range(n))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d
), x AS (
  SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), y AS (
  SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS hit FROM x
), z AS (
  SELECT doc_id, hit OR coalesce(lag(hit) OVER o, false) OR coalesce(lag(hit, 2) OVER o, false) AS covered FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), rep AS (
  SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM z GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, len(list_filter(ws, lambda x: x[-1] IN ('.', '!', '?')))::BIGINT AS n_marks, len(list_distinct(ws))::BIGINT AS n_distinct,
    len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{L}}{{1,3}}$')))::BIGINT AS n_short
  FROM d LEFT JOIN rep USING (doc_id)
), r AS (SELECT *, {votes} FROM f
), patterns AS (SELECT {keys}, count(*)::DOUBLE AS n FROM r GROUP BY ALL
), {", ".join(steps)}
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 / (1 + exp(-({odds}))) >= {THRESHOLD} AS kept
FROM r JOIN patterns p ON {same}, it{ITERATIONS} s
"""


OP1_SQL = _sql()
