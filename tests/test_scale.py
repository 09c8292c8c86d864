"""Forms made for large inputs against the plain ones: segments, counts of values, bits of a table's rows, linear scans."""

import os
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import pii
from loomtrace.functions.steps import in_session
from loomtrace.operators import corpus
from loomtrace.operators import sessions as ops
from loomtrace.plans.catalog import QUERIES
from loomtrace.sources import adapters

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def steps(spark):
    draw = random.Random(5)
    kinds = ["user_text", "assistant_text", "tool_use", "tool_result", "tool_use", None]
    rows = [(s, i, draw.choice(kinds), draw.choice([None, draw.randrange(1000)])) for s in ("a", "b", "c", "d") for i in range({"a": 50, "b": 1, "c": 3, "d": 7}[s])]
    return spark.createDataFrame(rows, "session_id string, step_index int, kind string, timestamp_ms long").cache()


def same(a, b):
    a, b = a.select(sorted(a.columns)), b.select(sorted(b.columns))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_windows_in_segments_equal_windows_over_sessions(steps, monkeypatch, size):
    monkeypatch.setattr(ops, "SEGMENT", size)
    tool = F.col("kind").isin("tool_use", "tool_result")
    got = ops.tool_density(steps)
    same(got.drop("bucket"), steps.select("session_id", "step_index", "kind", F.count(F.when(tool, 1)).over(in_session().rowsBetween(-5, 5)).alias("density")))
    island = F.sum(F.when(F.col("kind").eqNullSafe(F.lag("kind").over(in_session())), 0).otherwise(1)).over(in_session())
    islands = steps.select("session_id", "step_index", "kind", island.alias("island"))
    large = F.count(F.lit(1)).over(W.partitionBy("session_id", "island")) >= 2
    same(ops.parallel_batches(steps), islands.withColumn("in_batch", F.coalesce(tool, F.lit(False)) & large).drop("island"))
    latest = F.last(F.when(F.col("kind").isin("user_text", "assistant_text"), F.col("step_index")), ignorenulls=True)
    same(ops.text_context(steps), steps.select("session_id", "step_index", "kind", latest.over(in_session().rowsBetween(W.unboundedPreceding, 0)).alias("context_index")))
    gap = F.col("timestamp_ms") - F.lag("timestamp_ms").over(in_session())
    same(ops.durations(steps), steps.withColumn("duration_ms", F.when(gap >= 0, gap)))


def test_no_window_sorts_a_whole_session(steps):
    for f in (ops.tool_density, ops.parallel_batches, ops.durations):
        plan = f(steps)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(session_id" in plan and "segment" in plan.split("hashpartitioning(session_id")[1].split(")")[0]


def _sessions(spark, values):
    zero = F.lit(0).cast("long")
    return spark.createDataFrame([(v,) for v in values], "v long").withColumns({c: zero for c in ("fork_root_count", "annotation_count", "error_count")})


@pytest.mark.parametrize("seed", range(3))
def test_distributions_of_mostly_equal_values(spark, seed):
    draw = random.Random(seed)
    values = [0] * 900 + [draw.randrange(1, 50) for _ in range(draw.randrange(1, 120))] + [None] * 7
    draw.shuffle(values)
    r = corpus.distributions(_sessions(spark, values), {"v": F.col("v"), "w": F.col("v") * 2}).first()
    known = sorted(v for v in values if v is not None)
    for q, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        assert r[f"v_{q}"] == known[int(np.ceil(len(known) * p)) - 1] and r[f"w_{q}"] == 2 * r[f"v_{q}"]
    assert (r.sessions, r.v_min, r.v_max, r.v_total) == (len(values), 0, known[-1], sum(known)) and abs(r.v_mean - np.mean(known)) < 1e-9
    empty = corpus.distributions(_sessions(spark, []), {"v": F.col("v")}).first().asDict()
    assert set(empty.values()) == {0}


def test_equal_values_are_counted_where_they_lie(spark, monkeypatch):
    """What is dealt out is a row per distinct value and task, not a row per session."""
    seen = []
    plain = corpus.stored
    monkeypatch.setattr(corpus, "stored", lambda df, name: seen.append(plain(df, name)) or seen[-1])
    corpus.distributions(_sessions(spark, [0] * 20_000 + list(range(50))), {"v": F.col("v")}).first()
    assert [x.filter("m = 'v'").count() for x in seen] == [50]


def test_long_alignments():
    draw = random.Random(2)
    left, right = (draw.choices("abcdefgh", k=20_000) for _ in range(2))
    began = time.time()
    rows = corpus.align(left, right)
    assert time.time() - began < 5
    pairs = [(i, j) for i, j in rows if i is not None and j is not None]
    assert all(left[i] == right[j] for i, j in pairs) and pairs == sorted(pairs)
    assert sorted(i for i, _ in rows if i is not None) == list(range(20_000)) == sorted(j for _, j in rows if j is not None)


@needs_tables
def test_registered_alignment_equals_the_whole_table(spark):
    """Counts of every session and the next, by the plain table of common lengths."""
    steps = adapters.event_steps(spark, FOLDER).select("session_id", "step_index", "kind", "tool_name", "detail").toPandas()
    by = {int(s): rows.sort_values("step_index") for s, rows in steps.groupby("session_id")}
    signed = {s: (list(zip(r["kind"], r["tool_name"].fillna("-"), strict=True)), list(r["detail"])) for s, r in by.items()}

    def counts(a, b):
        (x, dx), (y, dy) = a, b
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        i, j, equal, other = len(x), len(y), 0, 0
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                equal, other = equal + (dx[i] == dy[j]), other + (dx[i] != dy[j])
            elif table[i - 1, j] >= table[i, j - 1]:
                i -= 1
            else:
                j -= 1
        return equal, other, len(x) - equal - other, len(y) - equal - other

    wanted = {f"{s}:{s + 1}": counts(signed[s], signed[s + 1]) for s in signed if s + 1 in signed}
    got = {r.pair_id: (r.match, r.differ, r.left_only, r.right_only) for r in QUERIES["align_sessions"](spark, FOLDER).collect()}
    assert got == wanted and wanted


def test_mail_scan_is_linear(spark):
    """Long runs of letters beside an @, before it and behind."""
    run = "QUJD" * 250_000
    texts = [run + "@host.example", run + " @ " + run, "x@" + run, "to a.b+c@d.example, e@f.example@g.example and @h.example", "é" * 10 + "i@j.example"]
    began = time.time()
    rows = pii.scan_pii(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").filter("category = 'email'").collect()
    assert time.time() - began < 10
    found = [(r.id, len(r.snippet), r.snippet[-20:]) for r in rows]
    assert sorted(found) == sorted([
        (0, len(run) + 13, (run + "@host.example")[-20:]),
        (3, 15, "a.b+c@d.example"), (3, 11, "e@f.example"), (3, 19, "f.example@g.example"), (4, 11, "i@j.example"),
    ])


@needs_tables
def test_percentiles_of_the_tables(spark):
    con = duckdb.connect()
    counts = sorted(n for (n,) in con.execute(f"SELECT count(*) FROM '{FOLDER}/events.parquet' GROUP BY user_id").fetchall())
    r = QUERIES["trajectory_stats"](spark, FOLDER).first()
    assert r.steps_p90 == counts[int(np.ceil(len(counts) * 0.9)) - 1]
