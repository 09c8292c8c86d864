"""Writers, session documents, small functions, and streams that come in several files."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import pii
from loomtrace.functions import steps as fs
from loomtrace.operators import export
from loomtrace.operators import sessions as ops
from loomtrace.sources import adapters
from loomtrace.streaming import live

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    parts = [
        ("s", 0, "user_text", "hi", None, None, None, None, 1000, None, None),
        ("s", 1, "tool_use", None, "Read", "c1", "{}", None, 1500, "gpt-5", 10),
        ("s", 2, "tool_result", None, None, "c1", None, "Error: gone", None, None, None),
        ("t", 0, "assistant_text", "alone", None, None, None, None, None, None, None),
    ]
    names = "session_id string, position int, kind string, text string, tool_name string, tool_call_id string, input_text string, result_text string, timestamp_ms long, model string, tokens_in long"
    rows = spark.createDataFrame(parts, names)
    rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("tokens_out", "cache_read", "cache_create")})
    return adapters.finish(ops.paired(rows), "generic").cache()


def test_session_lines_keep_nulls(steps, tmp_path):
    export.write_session_lines(ops.sessions(steps), f"{tmp_path}/lines")
    rows = {}
    for part in (tmp_path / "lines").glob("part-*"):
        for line in part.read_text().splitlines():
            row = json.loads(line)
            rows[row["path"]] = row
    assert rows["s"]["tool_counts"] == [{"name": "Read", "count": 1}] and rows["s"]["error_count"] == 1
    assert rows["s"]["format"] == "Generic conversation" and rows["s"]["mtime_secs"] == 1
    assert rows["t"]["cost_usd"] is None and rows["t"]["mtime_secs"] is None and rows["t"]["models"] == []


def test_session_documents(spark, steps):
    notes = spark.createDataFrame([("s", 2, "b", 1, 2), ("s", 1, "a", 3, 4)], "session_id string, step_index int, text string, created_at_ms long, updated_at_ms long")
    got = {r[0]: json.loads(r[1]) for r in export.json_documents(steps, ops.sessions(steps), notes).collect()}
    assert [x["text"] for x in got["s"]["annotations"]] == ["a", "b"] and "annotations" not in got["t"]
    assert got["s"]["totals"]["tokens_in"] == 10 and [x["kind"] for x in got["s"]["steps"]] == ["user_text", "tool_use", "tool_result"]
    assert "duration_ms" not in got["s"]["steps"][0] and got["s"]["steps"][1]["duration_ms"] == 500


def test_first_labels(steps):
    got = {r[0]: r[1] for r in ops.first_labels(steps, 2).collect()}
    assert got["s"] == ["[user]   hi", "[tool]   Read (c1)"] and got["t"] == ["[asst]   alone"]


def test_relative_times(spark):
    cases = {None: "?", -5: "future", 59: "just now", 60: "1m ago", 7200: "2h ago", 90000: "1d ago", 2592000 * 3: "3mo ago"}
    rows = spark.createDataFrame([(None if d is None else 10_000_000 - d, want) for d, want in cases.items()], "at long, want string")
    assert all(r[0] == r[1] for r in rows.select(fs.relative_time(F.col("at"), F.lit(10_000_000)), "want").collect())


def test_prefixes_are_scanned_one_by_one(spark):
    long = "x" * 24
    texts = {"stripe_secret_key": f"sk_live_{long} sk_test_{long}", "stripe_publishable_key": f"pk_live_{long} pk_test_{long}", "aws_access_key": f"AKIAASIA{'A' * 16}"}
    got = [r["category"] for r in pii.scan_pii(spark.createDataFrame([(t,) for t in texts.values()], "text string"), "text").collect()]
    assert sorted(got) == sorted(2 * list(texts))  # a token with two prefixes is found twice


def _event_files(spark, folder, order):
    """The events cut by time into three parts; a stream reads files in the order they were written."""
    import os

    rows = spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("ts", "event_id").toPandas()
    cut = len(rows) // 3
    for at, k in enumerate(order):
        path = f"{folder}/events-{at}.parquet"
        rows.iloc[k * cut : (k + 1) * cut if k < 2 else None].to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_000_000 + at, 1_000_000 + at))


def _rows(events):
    p = adapters.event_parts(events)
    full = fs.detail(F.col("kind"), F.col("text"), F.col("tool_name"), F.col("tool_call_id"), F.col("input_text"), F.col("result_text"))
    return p.select("session_id", F.col("event_id").alias("step_id"), F.timestamp_millis("timestamp_ms").alias("at"), "kind", full.alias("detail"), "tool_name")


@pytest.mark.skipif(not __import__("os").path.isdir(FOLDER), reason="needs the test tables")
def test_streams_of_several_files(spark, tmp_path):
    schema = spark.read.parquet(f"{FOLDER}/events.parquet").schema
    batch = _rows(spark.read.parquet(f"{FOLDER}/events.parquet"))
    wanted = {r["step_id"] for r in batch.filter(fs.is_error(F.col("kind"), F.col("detail"))).collect()}
    for name, order in (("in_time", (0, 1, 2)), ("late", (2, 0, 1))):
        (tmp_path / name).mkdir()
        _event_files(spark, tmp_path / name, order)
        stream = _rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"))
        got = {r["step_id"] for r in live.drained(spark, live.new_errors(stream), "append").collect()}
        if name == "in_time":
            assert got == wanted
        else:  # what is older than the watermark is dropped, as the docstring says
            assert got < wanted
        totals = _rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"))
        rows = live.drained(spark, live.live_totals(totals), "complete").agg(F.sum("steps"), F.sum("errors")).first()
        assert tuple(rows) == (batch.count(), len(wanted))
    with pytest.raises(ValueError):
        live.drained(spark, live.live_totals(totals), "update")
