"""Per-session operators: pairing, durations, totals, tool statistics, windows, slices, searches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions.steps import in_session, is_error, with_cost

#: Steps of a session that one task takes at a time in the windows below.
SEGMENT = 100_000

KINDS = ("user_text", "assistant_text", "tool_use", "tool_result")


def paired(steps: DataFrame) -> DataFrame:
    """Tool results with their call's tool and input, by session and call id; the last call of an id wins, orphans stay.

    steps has session_id, position, kind, tool_name, tool_call_id, input_text. Sessions move once;
    pairing and what follows by session work on that partitioning.
    """
    used_at = F.when(F.col("kind") == "tool_use", F.col("position"))
    call = F.max_by(F.struct("tool_name", "input_text"), used_at).over(W.partitionBy("session_id", "tool_call_id"))
    found = (F.col("kind") == "tool_result") & F.col("tool_call_id").isNotNull()
    rows = steps.repartition("session_id").withColumn("call", F.when(found, call))
    result = F.col("kind") == "tool_result"
    own = lambda c: F.when(result, F.col(f"call.{c}")).otherwise(F.col(c))
    return rows.withColumns({"tool_name": own("tool_name"), "input_text": own("input_text")}).drop("call")


def with_halo(steps: DataFrame, before: int, after: int) -> DataFrame:
    """steps cut into segments of SEGMENT indices; each also gets the given numbers of rows before and after it.

    Adds segment, and own: false for the rows lent from neighbours. Step indices are those of the whole
    session, without holes. A window by session_id and segment then sees what its rows need, and no task
    a whole session.
    """
    of = lambda i: F.floor(i / SEGMENT)
    index = F.col("step_index")
    reached = F.sequence(F.greatest(of(index - after), F.lit(0).cast("long")), of(index + before))
    rows = steps.withColumn("segment", F.explode(reached))
    return rows.withColumn("own", F.col("segment") == of(index))


def in_segment() -> WindowSpec:
    return W.partitionBy("session_id", "segment").orderBy("step_index")


def durations(steps: DataFrame) -> DataFrame:
    """duration_ms: the gap to the step before; null for the first, a missing side or a negative gap."""
    rows = with_halo(steps, 1, 0).withColumn("_before", F.lag("timestamp_ms").over(in_segment()))
    gap = F.col("timestamp_ms") - F.col("_before")
    return rows.filter("own").withColumn("duration_ms", F.when(gap >= 0, gap)).drop("segment", "own", "_before")


def step_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("session_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])


def session_totals(steps: DataFrame) -> DataFrame:
    """Token sums (null counts as 0), cost (null if none is known), steps and fork roots per session."""
    tokens = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "cache_read", "cache_create")]
    return (
        with_cost(steps)
        .groupBy("session_id")
        .agg(
            F.first("format").alias("format"),
            F.count(F.lit(1)).alias("step_count"),
            *tokens,
            (F.sum("cost_nano") / 1e9).alias("cost_usd"),
            F.count_if("is_fork_root").alias("fork_root_count"),
            F.max("timestamp_ms").alias("last_ms"),
        )
    )


def fork_root_indices(steps: DataFrame) -> DataFrame:
    """The ordered indices of each session's fork roots; [] without any."""
    at = F.array_sort(F.collect_list(F.when(F.col("is_fork_root"), F.col("step_index"))))
    return steps.groupBy("session_id").agg(at.alias("fork_root_indices"))


def session_models(steps: DataFrame) -> DataFrame:
    """Distinct models of a session in the order they are first seen."""
    first = steps.filter("model is not null").groupBy("session_id", "model").agg(F.min("step_index").alias("at"))
    return first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("models"))


def tool_stats(steps: DataFrame) -> DataFrame:
    """Per session and tool: uses, results, errors, both error rates; steps without a tool don't count."""
    by = steps.filter("tool_name is not null").groupBy("session_id", "tool_name")
    errors = F.count_if(is_error(F.col("kind"), F.col("detail")))
    stats = by.agg(
        F.count_if(F.col("kind") == "tool_use").alias("use_count"),
        F.count_if(F.col("kind") == "tool_result").alias("result_count"),
        errors.alias("error_count"),
    )
    rate = lambda n: F.when(F.col(n) > 0, F.col("error_count") / F.col(n))
    return stats.withColumn("error_rate", rate("result_count")).withColumn("error_rate_of_uses", rate("use_count"))


TOOL_STATS = "array<struct<name:string,use_count:bigint,result_count:bigint,error_count:bigint>>"


def sessions(steps: DataFrame, notes: DataFrame | None = None, mtimes: DataFrame | None = None) -> DataFrame:
    """One row per session: totals, counts by kind, models, tool statistics (by uses, then name), notes, time of change.

    Steps are read once: they are added up by session, tool and model, and a session's few sums
    are then put together.
    """
    counters = ("tokens_in", "tokens_out", "cache_read", "cache_create")
    counted = with_cost(steps).groupBy("session_id", "tool_name", "model").agg(
        F.first("format").alias("format"),
        F.count(F.lit(1)).alias("step_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters],
        F.sum("cost_nano").alias("cost_nano"),
        F.count_if("is_fork_root").alias("fork_root_count"),
        F.max("timestamp_ms").alias("last_ms"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.count_if(is_error(F.col("kind"), F.col("detail"))).alias("error_count"),
        F.min("step_index").alias("first_step"),
    )
    tool = F.when(
        F.col("tool_name").isNotNull(),
        F.struct(
            F.col("tool_name").alias("name"),
            F.col("n_tool_use").alias("use_count"),
            F.col("n_tool_result").alias("result_count"),
            "error_count",
        ),
    )
    model = F.when(F.col("model").isNotNull(), F.struct("first_step", "model"))
    sums = ("step_count", *counters, "fork_root_count", *[f"n_{k}" for k in KINDS])
    whole = counted.groupBy("session_id").agg(
        F.first("format").alias("format"),
        *[F.sum(c).alias(c) for c in sums],
        (F.sum("cost_nano") / 1e9).alias("cost_usd"),
        F.max("last_ms").alias("last_ms"),
        F.coalesce(F.sum(F.when(F.col("tool_name").isNotNull(), F.col("error_count"))), F.lit(0)).alias("error_count"),
        F.collect_list(tool).alias("tools"),
        F.array_sort(F.collect_list(model)).alias("seen"),
    )  # the lists hold a session's tools and models

    def of_tool(name: Column) -> Column:
        own = F.filter("tools", lambda t: t["name"] == name)
        total = lambda c: F.aggregate(own, F.lit(0).cast("long"), lambda a, t: a + t[c])
        return F.struct(
            (-total("use_count")).alias("o"),
            name.alias("name"),
            *[total(c).alias(c) for c in ("use_count", "result_count", "error_count")],
        )

    names = F.array_distinct(F.transform("tools", lambda t: t["name"]))
    stats = F.transform(
        F.array_sort(F.transform(names, of_tool)),
        lambda t: F.struct(*[t[c].alias(c) for c in ("name", "use_count", "result_count", "error_count")]),
    )
    out = (
        whole
        .withColumns({"tool_stats": stats.cast(TOOL_STATS), "models": F.array_distinct(F.transform("seen", lambda x: x["model"]))})
        .drop("tools", "seen")
    )
    if notes is not None:
        counts = notes.groupBy("session_id").agg(F.count(F.lit(1)).alias("annotation_count"))
        out = out.join(counts, "session_id", "left").withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0)))
    else:
        out = out.withColumn("annotation_count", F.lit(0).cast("long"))
    return out.join(mtimes, "session_id", "left") if mtimes is not None else out.withColumn("mtime_secs", F.floor(F.col("last_ms") / 1000))


def first_labels(steps: DataFrame, n: int = 20) -> DataFrame:
    """The first n labels of each session, in order."""
    return (
        steps
        .filter(F.col("step_index") < n)
        .groupBy("session_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("step_index", "label"))), lambda x: x["label"]).alias("labels"))
    )


def top_tools(steps: DataFrame, n: int = 8) -> DataFrame:
    order = W.partitionBy("session_id").orderBy(F.desc("use_count"), "tool_name")
    return tool_stats(steps).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def recent_errors(steps: DataFrame, n: int = 5) -> DataFrame:
    """The last n error results of each session, newest first, orphans included."""
    order = W.partitionBy("session_id").orderBy(F.desc("step_index"))
    found = steps.filter(is_error(F.col("kind"), F.col("detail")))
    return (
        found
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("session_id", "step_index", "tool_name", F.substring("detail", 1, 200).alias("preview"), "rank")
    )


# windows


def tool_density(steps: DataFrame, reach: int = 5) -> DataFrame:
    """Tool steps within reach rows either way, and the heat bucket (0 to 5) of that number."""
    near = F.count(F.when(F.col("kind").isin("tool_use", "tool_result"), 1)).over(in_segment().rowsBetween(-reach, reach))
    bucket = (
        F.when(F.col("density") == 0, 0)
        .when(F.col("density") <= 2, 1)
        .when(F.col("density") <= 4, 2)
        .when(F.col("density") <= 7, 3)
        .when(F.col("density") <= 10, 4)
        .otherwise(5)
    )
    rows = with_halo(steps.select("session_id", "step_index", "kind"), reach, reach).withColumn("density", near)
    return rows.filter("own").drop("segment", "own").withColumn("bucket", bucket)


def parallel_batches(steps: DataFrame) -> DataFrame:
    """in_batch: the step belongs to two or more consecutive tool steps of its kind, that is, has one like it beside it."""
    rows = with_halo(steps.select("session_id", "step_index", "kind"), 1, 1)
    like = lambda kind: kind.over(in_segment()).eqNullSafe(F.col("kind"))
    rows = rows.withColumn("in_batch", F.coalesce(F.col("kind").isin("tool_use", "tool_result"), F.lit(False)) & (like(F.lag("kind")) | like(F.lead("kind"))))
    return rows.filter("own").drop("segment", "own")


def text_context(steps: DataFrame) -> DataFrame:
    """context_index: the latest text step at or before each step.

    Each segment's last text is carried to the segments behind it, a row a segment.
    """
    rows = with_halo(steps.select("session_id", "step_index", "kind"), 0, 0).drop("own")
    text = F.when(F.col("kind").isin("user_text", "assistant_text"), F.col("step_index"))
    last = rows.groupBy("session_id", "segment").agg(F.max(text).alias("_last"))
    earlier = W.partitionBy("session_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("session_id", "segment", F.max("_last").over(earlier).alias("_carried")).filter("_carried is not null")
    rows = rows.withColumn("context_index", F.max(text).over(in_segment().rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(carried, ["session_id", "segment"], "left")
    return rows.select("session_id", "step_index", "kind", F.coalesce("context_index", "_carried").alias("context_index"))


def fork_flags(entries: DataFrame) -> DataFrame:
    """is_fork_root for entries (session_id, entry, parent, first): first steps of entries whose parent has two children or more; a null parent counts."""
    siblings = F.count(F.lit(1)).over(W.partitionBy("session_id", "parent"))
    return entries.withColumn("is_fork_root", (siblings > 1) & F.col("first"))


# filters


def slice_steps(steps: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Steps start (included) to end (excluded), from 0, numbered anew."""
    if start is not None and end is not None and start > end:
        raise ValueError(f"start {start} is after end {end}")
    kept = steps.filter((F.col("step_index") >= (start or 0)) & (F.lit(True) if end is None else F.col("step_index") < end))
    return kept.withColumn("step_index", (F.row_number().over(in_session()) - 1).cast("int"))


def parse_duration(text: str) -> int:
    """Milliseconds of 1h30m, 90s, 45m or plain seconds."""
    if re.fullmatch(r"\d+", text.strip()):
        return int(text) * 1000
    found = re.findall(r"(\d+)(ms|h|m|s)", text.strip())
    if not found or "".join(a + b for a, b in found) != text.strip():
        raise ValueError(f"no duration: {text!r}")
    return sum(int(n) * {"h": 3_600_000, "m": 60_000, "s": 1000, "ms": 1}[u] for n, u in found)


def slice_time(steps: DataFrame, after_ms: int | None = None, before_ms: int | None = None) -> DataFrame:
    """Steps at an offset from the session's first known time (in order): from after_ms up to before_ms; sessions without times pass whole."""
    anchor = (
        F.first("timestamp_ms", ignorenulls=True)
        .over(W.partitionBy("session_id").orderBy("step_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    )
    offset = F.greatest(F.col("timestamp_ms") - F.col("_anchor"), F.lit(0))
    inside = F.lit(True)
    inside = inside & (offset >= after_ms) if after_ms is not None else inside
    inside = inside & (offset < before_ms) if before_ms is not None else inside
    kept = steps.withColumn("_anchor", anchor).filter(F.col("_anchor").isNull() | (F.col("timestamp_ms").isNotNull() & inside)).drop("_anchor")
    return kept.withColumn("step_index", (F.row_number().over(in_session()) - 1).cast("int"))


def first_at(steps: DataFrame, offset_ms: int) -> DataFrame:
    """The first step, in order, at or after an offset from the session's first known time."""
    anchor = (
        F.first("timestamp_ms", ignorenulls=True)
        .over(W.partitionBy("session_id").orderBy("step_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    )
    return (
        steps
        .select("session_id", "step_index", "timestamp_ms", anchor.alias("a"))
        .filter(F.col("timestamp_ms") >= F.col("a") + offset_ms)
        .groupBy("session_id")
        .agg(F.min("step_index").alias("step_index"))
    )


def label_filter(steps: DataFrame, query: str) -> DataFrame:
    return steps.filter(F.contains(F.lower("label"), F.lit(query.strip().lower())))


def search(steps: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first limit steps of each session with the text in label or detail."""
    q = F.lit(query.lower())
    found = steps.filter(F.contains(F.lower("label"), q) | F.contains(F.lower("detail"), q))
    return (
        found
        .withColumn("rank", F.row_number().over(in_session()))
        .filter(F.col("rank") <= limit)
        .select("session_id", "step_index", "kind", F.substring("detail", 1, 120).alias("preview"), "rank")
    )


def conversation(steps: DataFrame) -> DataFrame:
    return steps.filter(F.col("kind").isin("user_text", "assistant_text"))
