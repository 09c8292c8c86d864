"""Alerts of sessions that fall idle and of files that grow, batch by batch."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomtrace.operators.storage import fresh_path
from loomtrace.plans import raw
from loomtrace.sources.formats import read_files
from loomtrace.streaming import live, watch

HOUR = 3_600_000


@pytest.fixture(scope="module")
def child(spark):
    return watch.with_state_store(spark)


def _idle(child, folder, batches, gap=2 * HOUR):
    """What is alerted for batches of (session, hour), read one by one."""
    for k, rows in enumerate(batches):
        at = F.timestamp_millis((F.col("hour") * HOUR).cast("long"))
        child.createDataFrame(rows, "session_id string, hour double").select("session_id", at.alias("at")).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = f"{folder}/{name}"
            if os.path.getmtime(path) > 2_000_000:
                os.utime(path, (1_000_000 + k, 1_000_000 + k))
    stream = child.readStream.schema("session_id string, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    found = live.drained(child, watch.idle_alerts(stream, gap), "append").collect()
    return sorted((r.session_id, r.alert, r.started_ms / HOUR, r.idle_ms / HOUR, r.steps, r.steps_so_far) for r in found)


def test_an_open_session_is_alerted_once_and_armed_again(child, tmp_path):
    got = _idle(child, str(tmp_path / "a"), [[("s", 1.0), ("s", 1.5), ("t", 1.0)], [("t", 4.6)], [("s", 6.0), ("t", 6.2)], [("t", 8.0), ("t", 9.5)]])
    # s falls idle at 3.5 although nothing of it follows, wakes at 6 and falls idle again at 8; t's last spell is still open
    assert got == [("s", 1, 1.0, 3.5, 2, 2), ("s", 2, 6.0, 8.0, 1, 3), ("t", 1, 1.0, 3.0, 1, 1)]


def test_steps_out_of_order_join_the_spells_they_lie_between(child, tmp_path):
    got = _idle(child, str(tmp_path / "b"), [[("s", 5.0), ("s", 1.0)], [("s", 3.0), ("u", 5.5)], [("u", 20.0)]])
    # rows count as late by the batch before, so that 3.0 still joins both ends before their timers are looked at
    assert got == [("s", 1, 1.0, 7.0, 3, 3), ("u", 1, 5.5, 7.5, 1, 1)]
    got = _idle(child, str(tmp_path / "c"), [[("s", 3.0), ("s", 1.0)], [("s", 2.5), ("u", 3.2)], [("u", 20.0)]], gap=int(1.6 * HOUR))
    assert got == [("s", 1, 1.0, 4.6, 3, 3), ("u", 1, 3.2, 4.8, 1, 1)]


class _Store:
    """A session's state and timers beside Spark; counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    put = update

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.timer


def _step(watch_, store, at, watermark):
    """One batch as Spark runs it: rows, then timers up to the watermark."""
    store.watermark, out = watermark, []
    if at:
        list(watch_.handleInputRows(("s",), iter([pd.DataFrame({"at_ms": at})]), store))
    for store.timer in sorted(t for t in store.timers if t <= watermark):
        store.timers.discard(store.timer)
        out += [tuple(map(int, x[1:])) for part in watch_.handleExpiredTimer(("s",), store, store) for x in part.itertuples(index=False)]
    return out


def test_spells_of_a_session_share_a_timer_and_a_row_of_state():
    store, one = _Store(), watch.IdleWatch(10)
    one.init(store)
    assert _step(one, store, [100 * k for k in range(3_000)], 0) == [] and len(store.timers) == 1
    found = _step(one, store, [], 100 * 2_000 + 10)  # the last one ends at the watermark itself
    assert found == [(100 * k, 100 * k + 10, 1, k + 1, k + 1) for k in range(2_001)]
    assert len(store.timers) == 1 and store.calls < 12


def test_the_timer_follows_the_earliest_spell():
    store, one = _Store(), watch.IdleWatch(10)
    one.init(store)
    assert _step(one, store, [50], 0) == [] and store.timers == {60}
    assert _step(one, store, [20], 0) == [] and store.timers == {30}  # an earlier spell comes late
    assert _step(one, store, [28], 25) == [] and store.timers == {30}  # it goes on: the timer finds nothing over
    assert _step(one, store, [], 31) == [] and store.timers == {38}
    assert _step(one, store, [], 40) == [(20, 38, 2, 1, 2)] and store.timers == {60}
    assert _step(one, store, [], 90) == [(50, 60, 1, 2, 3)] and store.timers == set()
    assert _step(one, store, [95], 90) == [] and store.timers == {105}
    assert _step(one, store, [], 105) == [(95, 105, 1, 3, 4)] and store.timers == set()


def test_merged_spells():
    assert watch.merged([(9, 9, 1), (1, 3, 2), (4, 4, 1), (6, 7, 1)], 2) == [(1, 9, 5)]
    assert watch.merged([(9, 9, 1), (1, 3, 2)], 2) == [(1, 3, 2), (9, 9, 1)]
    assert watch.merged([], 2) == []


def _chat(results):
    messages = []
    for k, text in enumerate(results):
        messages.append({"role": "assistant", "content": None, "tool_calls": [{"id": f"c{k}", "function": {"name": "Read", "arguments": "{}"}}]})
        messages.append({"role": "tool", "tool_call_id": f"c{k}", "content": text})
    return json.dumps({"messages": messages})


def test_files_that_grow_are_cut_and_rewritten(child, tmp_path):
    """Each step: what the file holds, and the indices of the errors that are new."""
    bad, good = "Error: gone", "fine"
    looks = [
        (_chat([bad, good]), []),  # first seen: nothing is new
        (_chat([bad, good, bad]), [5]),  # appended
        (_chat([bad, good, bad])[:-20], []),  # half written: left for later
        (_chat([bad, good, bad, good, bad]), [9]),
        (_chat([good, bad, good, good, bad]), []),  # rewritten at the same length
        (_chat([bad]), []),  # cut
        (_chat([bad, bad, good]), [3]),  # grows from there
        ('{"messages":[]}', []),
        (_chat([bad]), [1]),
    ]
    folder, spool = tmp_path / "files", fresh_path(child, "spool")
    folder.mkdir()
    (folder / "other.json").write_text(_chat([good]))
    os.utime(folder / "other.json", (100, 100))
    state = str(tmp_path / "state")
    wanted = []
    for version, (text, new) in enumerate(looks):
        (folder / "one.json").write_text(text)
        os.utime(folder / "one.json", (1_000 + version, 1_000 + version))
        watch.snapshot(watch.changed(read_files(child, str(folder)), 1_000 + version if version else 0), version, spool)
        wanted += [(version, i) for i in new]
        if version in (3, len(looks) - 1):  # the stream runs twice, with the state of its first run
            query = (
                watch.grown_errors(watch.spool_stream(child, spool)).writeStream.format("parquet")
                .option("path", f"{state}/out").option("checkpointLocation", f"{state}/at").trigger(availableNow=True).start()
            )
            query.awaitTermination()
            found = child.read.parquet(f"{state}/out").collect()
            assert sorted((r.version, r.step_index) for r in found) == wanted
    assert all(r.session_id.endswith("one.json") and "Error: gone" in r.label for r in found)


def test_growth_reads_and_writes_state_once_and_leaves_errors_whole():
    store, one = _Store(), watch.GrowthWatch()
    one.init(store)
    look = lambda *rows: [tuple(x) for x in one.handleInputRows(("s",), iter([Row(version=v, n=n, errors=e) for v, n, e in rows]), None)]
    # first seen, grown, cut, grown without errors, grown again; a row a look that grew and has errors
    assert look((2, 5, "c"), (0, 10, "a"), (1, 20, "b"), (3, 6, None), (4, 9, "e")) == [("s", 1, 10, "b"), ("s", 4, 6, "e")]
    assert store.calls == 2 and store.value == (9, 4)
    assert look((4, 50, "late"), (5, 12, "f")) == [("s", 5, 9, "f")]


def test_events_move_before_they_are_written_as_messages(spark, tmp_path):
    at = F.timestamp_millis(F.col("id") * 1000).alias("ts")
    rows = spark.range(40).select(F.col("id").alias("event_id"), at, (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    messages = raw.chat_messages(spark, str(tmp_path))
    plan = messages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "to_json" not in plan[plan.index("Exchange") :] and "structstojson" not in plan[plan.index("Exchange") :].lower()
    assert {r.path: len(r.lines) for r in messages.collect()} == {"0": 14, "1": 13, "2": 13}
    assert {len(json.loads(r.content)["messages"]) for r in raw.chats(messages, "n div 2").collect()} == {7, 6}
