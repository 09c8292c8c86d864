"""Alerts with a session's own state: idle sessions by timers, and new errors of files that grow.

State lies in RocksDB stores, which need Spark's provider for them: start these streams in the session
that with_state_store() gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomtrace.functions.steps import is_error
from loomtrace.sources.formats import detected, parse_detected

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session beside this one, with its settings, whose streams keep their state in RocksDB."""
    child = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if spark.conf.get(name, None) is not None:
            child.conf.set(name, spark.conf.get(name))
    child.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return child


def merged(spells: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Spells (first, last, steps) in order, put together where no more than the gap lies between them."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spells):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class IdleWatch(StatefulProcessor):
    """One alert when a session has had no step for the gap; a later step arms it again.

    State is one row a session: its open spells of activity in order (several only while the watermark
    lags behind), the time it has a timer for, the alerts given and the steps they saw. The one timer
    waits at the end of the earliest spell or before; when it goes off, all spells that ended by the
    watermark are alerted, so that state is read and written once a session and batch, not once a spell.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "firsts array<long>, lasts array<long>, counts array<long>, timer long, alerts long, steps long")

    def _load(self) -> tuple[list[tuple[int, int, int]], int | None, int, int]:
        row = self.state.get()
        if row is None:
            return [], None, 0, 0
        firsts, lasts, counts, timer, alerts, steps = row
        return list(zip(firsts, lasts, counts, strict=True)), timer, alerts, steps

    def _save(self, spells: list[tuple[int, int, int]], timer: int | None, alerts: int, steps: int) -> None:
        due = spells[0][1] + self.gap_ms if spells else None
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        firsts, lasts, counts = map(list, zip(*spells, strict=True)) if spells else ([], [], [])
        self.state.update((firsts, lasts, counts, timer, alerts, steps))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spells, *rest = self._load()
        for part in rows:
            spells = merged([*spells, *((t, t, 1) for t in part["at_ms"].tolist())], self.gap_ms)
        self._save(spells, *rest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs() - self.gap_ms
        spells, _, alerts, steps = self._load()
        over = [x for x in spells if x[1] <= due]  # none: the spell went on after this timer was set
        out = []
        for first, last, n in over:
            alerts, steps = alerts + 1, steps + n
            out.append((key[0], first, last + self.gap_ms, n, alerts, steps))
        self._save(spells[len(over) :], None, alerts, steps)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "started_ms", "idle_ms", "steps", "alert", "steps_so_far"])

    def close(self) -> None:
        pass


def idle_alerts(stream: DataFrame, gap_ms: int, late: str = "1 hour") -> DataFrame:
    """session_id, started_ms, idle_ms, steps, alert, steps_so_far: each time a session has been idle for the gap.

    stream has session_id and a timestamp `at`. A session whose last step lies the gap behind the
    watermark is alerted although nothing follows; steps after an alert arm it anew, as alert 2 and so
    on. Steps that come late but within the watermark count where they belong in time.
    """
    rows = stream.withWatermark("at", late).select("session_id", "at", F.unix_millis("at").alias("at_ms"))
    schema = "session_id string, started_ms long, idle_ms long, steps long, alert long, steps_so_far long"
    return rows.groupBy("session_id").transformWithStateInPandas(IdleWatch(gap_ms), schema, "append", "eventTime")


def snapshot(files: DataFrame, version: int, spool: str) -> None:
    """Adds what files (path, content) hold now to a spool that grown_errors() follows: session_id, version, n, errors.

    A row a file: its number of steps and its error steps. Files that can't be parsed at the moment
    (half a line is written) are left for the next time. Pass only files that changed, see changed().
    """
    known = detected(files.select("path", "content"))
    read = known.select(F.col("path").alias("session_id"))
    error = F.when(is_error(F.col("kind"), F.col("detail")), F.struct("step_index", "label"))
    counted = parse_detected(known).select("session_id", "step_index", F.count(F.lit(1)).over(W.partitionBy("session_id")).alias("n"), error.alias("error"))
    # a file's first step and its errors say all: the others needn't be gathered
    told = counted.filter((F.col("step_index") == 0) | F.col("error").isNotNull())
    steps = told.groupBy("session_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("error")).alias("errors"))
    rows = read.join(steps, "session_id", "left")
    rows.select("session_id", F.lit(version).cast("long").alias("version"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "errors").write.mode("append").parquet(spool)


def changed(files: DataFrame, since_secs: int) -> DataFrame:
    """Of read_files(), those changed at or after a time; the content of others isn't read."""
    return files.filter(F.col("mtime_secs") >= since_secs)


ERRORS = "array<struct<step_index: int, label: string>>"
SPOOL = f"session_id string, version long, n long, errors {ERRORS}"


class GrowthWatch(StatefulProcessor):
    """State is the number of steps last seen of a file; errors behind it are new if there are more steps now.

    A first sight gives no alert. A file with fewer steps was cut or rewritten: nothing is checked, and
    it is followed from its new length. A look at a file that grew gives one row: the steps seen before,
    and the errors as they came, as one text, which isn't taken apart here.
    """

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n long, version long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.seen.get()
        n_seen, last = (None, -1) if state is None else state
        out = []
        for version, n, errors in sorted(((r.version, r.n, r.errors) for r in rows), key=lambda x: x[:2]):
            if version <= last:
                continue  # a snapshot that was overtaken
            if n_seen is not None and n > n_seen and errors is not None:
                out.append(Row(session_id=key[0], version=version, n_seen=n_seen, errors=errors))
            n_seen, last = n, version
        self.seen.update((n_seen, last))
        return iter(out)

    def close(self) -> None:
        pass


def grown_errors(spool: DataFrame) -> DataFrame:
    """session_id, version, step_index, label of errors among steps that were appended to files (a stream of SPOOL rows)."""
    found = F.when(F.size("errors") > 0, F.to_json("errors"))
    rows = spool.select("session_id", "version", "n", found.alias("errors"))
    grown = rows.groupBy("session_id").transformWithState(GrowthWatch(), "session_id string, version long, n_seen long, errors string", "append", "none")
    return (
        grown
        .select("session_id", "version", "n_seen", F.inline(F.from_json("errors", ERRORS)))
        .filter("step_index >= n_seen")
        .select("session_id", "version", "step_index", "label")
    )


def spool_stream(spark: SparkSession, spool: str) -> DataFrame:
    return spark.readStream.schema(SPOOL).parquet(spool)
