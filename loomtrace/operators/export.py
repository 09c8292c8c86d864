"""Exports: session lines, corpus documents, fine-tuning trajectories, Markdown and HTML transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.steps import FORMAT_NAMES, format_duration, redact, with_cost
from loomtrace.operators import corpus


def redacted(steps: DataFrame, needles: list[str]) -> DataFrame:
    """Steps with needles replaced in label and detail only."""
    return steps.withColumns({c: redact(F.col(c), needles) for c in ("label", "detail")})


def format_name(fmt: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FORMAT_NAMES.items() for x in kv]), fmt)


def session_lines(sessions: DataFrame) -> DataFrame:
    """One flat row per session, for JSON lines that keep nulls."""
    counts = F.transform("tool_stats", lambda t: F.struct(t["name"].alias("name"), t["use_count"].alias("count")))
    return sessions.select(
        F.col("session_id").alias("path"),
        format_name(F.col("format")).alias("format"),
        "step_count",
        "tokens_in",
        "tokens_out",
        "cache_read",
        "cache_create",
        "cost_usd",
        "models",
        counts.alias("tool_counts"),
        "error_count",
        "annotation_count",
        "fork_root_count",
        "mtime_secs",
    )


def write_session_lines(sessions: DataFrame, path: str) -> None:
    session_lines(sessions).write.option("ignoreNullFields", "false").json(path)


def ordered_list(value: Column) -> Column:
    """The values of a session's steps in order; a session is the bound."""
    return F.transform(F.array_sort(F.collect_list(F.struct("step_index", value.alias("v")))), lambda x: x["v"])


def trajectories(steps: DataFrame) -> DataFrame:
    """session_id and a JSON document {messages: [...]} in the order of the steps; null fields are left out."""
    call_id = F.coalesce("tool_call_id", F.concat(F.lit("call_"), F.col("step_index")))
    calls = F.array(
        F.struct(
            call_id.alias("id"),
            F.lit("function").alias("type"),
            (
                F.struct(F.coalesce("tool_name", F.lit("unknown")).alias("name"), F.coalesce("input_text", F.lit("")).alias("arguments"))
                .alias("function")
            ),
        )
    )
    use, result = F.col("kind") == "tool_use", F.col("kind") == "tool_result"
    message = F.struct(
        F.when(F.col("kind") == "user_text", "user").when(result, "tool").otherwise("assistant").alias("role"),
        F.when(result, F.col("result_text")).when(~use, F.col("detail")).alias("content"),
        F.when(use, calls).alias("tool_calls"),
        F.when(result, call_id).alias("tool_call_id"),
    )
    return steps.groupBy("session_id").agg(F.to_json(F.struct(ordered_list(message).alias("messages"))).alias("line"))


def json_documents(steps: DataFrame, sessions: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """session_id and a JSON document of totals, steps and notes (absent without notes)."""
    step = F.struct(
        "step_index",
        "kind",
        "label",
        "detail",
        "tool_name",
        "tool_call_id",
        "timestamp_ms",
        "duration_ms",
        "model",
        "tokens_in",
        "tokens_out",
        "cache_read",
        "cache_create",
    )
    out = (
        steps
        .groupBy("session_id")
        .agg(ordered_list(step).alias("steps"))
        .join(
            sessions.select("session_id", F.struct("tokens_in", "tokens_out", "cache_read", "cache_create", "cost_usd", "models").alias("totals")),
            "session_id",
        )
    )
    fields = ["totals", "steps"]
    if notes is not None:
        listed = (
            notes
            .groupBy("session_id")
            .agg(F.array_sort(F.collect_list(F.struct("step_index", "text", "created_at_ms", "updated_at_ms"))).alias("annotations"))
        )
        out, fields = out.join(listed, "session_id", "left"), [*fields, "annotations"]
    return out.select("session_id", F.to_json(F.struct(*fields)).alias("document"))


def corpus_document(sessions: DataFrame, errors: DataFrame | None = None, kept: Column | None = None, file_count: int | None = None) -> DataFrame:
    """One row (document): counts and sums of the sessions that kept holds for, and their buckets by model, tool and format, as JSON.

    errors has a row per file that could not be parsed; file_count is the number of all files seen, by default of sessions and errors.
    The buckets' lists hold the corpus' models, tools and formats.
    """
    every = F.lit(True) if kept is None else kept
    own = sessions.filter(every)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{n}") for c, n in (("step_count", "steps"), *((c, c) for c in ("tokens_in", "tokens_out", "cache_read", "cache_create")))]
    row = own.agg(F.count(F.lit(1)).alias("parse_success_count"), *sums, F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"))
    counts = sessions.agg(F.count_if(~every).alias("filtered_out_count"), F.count(F.lit(1)).alias("n"))
    failed = (
        errors
        .agg(F.count(F.lit(1)).alias("parse_error_count")) if errors is not None else sessions.sparkSession
        .range(1)
        .select(F.lit(0).cast("long").alias("parse_error_count"))
    )

    def listed(buckets: DataFrame, name: str, by: str, fields: list[str]) -> DataFrame:
        item = F.struct((-F.col(by)).alias("o"), *fields)
        return buckets.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*[x[n].alias(n) for n in fields])).alias(name))

    model = listed(
        corpus.model_buckets(own).withColumn("cost_usd", F.round("cost_usd", 6)),
        "per_model",
        "session_count",
        ["model", "session_count", "tokens_in", "tokens_out", "cost_usd"],
    )
    stats = (
        own
        .select("session_id", F.explode("tool_stats").alias("t"))
        .select("session_id", F.col("t.name").alias("tool_name"), "t.use_count", "t.error_count")
    )
    tool = listed(
        corpus.tool_buckets(stats).withColumnRenamed("tool_name", "tool"),
        "per_tool",
        "use_count",
        ["tool", "use_count", "error_count", "session_count"],
    )
    fmt = listed(
        corpus.format_buckets(own).withColumn("format", format_name(F.col("format"))),
        "per_format",
        "session_count",
        ["format", "session_count"],
    )
    whole = row.withColumn("one", F.lit(1))
    for part in (counts, failed, model, tool, fmt):  # each of them one row
        whole = whole.join(part.withColumn("one", F.lit(1)), "one")
    files = F.col("n") + F.col("parse_error_count") if file_count is None else F.lit(file_count)
    names = [
        "parse_success_count",
        "parse_error_count",
        "filtered_out_count",
        "total_steps",
        "total_tokens_in",
        "total_tokens_out",
        "total_cache_read",
        "total_cache_create",
        "total_cost_usd",
        "per_model",
        "per_tool",
        "per_format",
    ]
    return whole.select(F.to_json(F.struct(files.alias("file_count"), *names), {"ignoreNullFields": "false"}).alias("document"))


def write_corpus_document(document: DataFrame, path: str) -> None:
    document.write.text(path)


def _four_digits(nano: Column) -> Column:
    """Nano-dollars as dollars with four digits."""
    tenth = F.floor((nano + 50_000) / 100_000)
    return F.when(nano.isNotNull(), F.format_string("$%d.%04d", F.floor(tenth / 10_000), tenth % 10_000))


#: Heads and names of kinds of steps.
HEADS = {
    "user_text": ("[user]", "user"),
    "assistant_text": ("[asst]", "assistant"),
    "tool_use": ("[tool]", "tool_use"),
    "tool_result": ("[result]", "tool_result"),
}


def _of_kind(part: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in HEADS.items() for x in (k, v[part])]), F.col("kind"))


def _with_note(steps: DataFrame, notes: DataFrame | None) -> DataFrame:
    costed = with_cost(steps)
    if notes is None:
        return costed.withColumn("note", F.lit(None).cast("string"))
    return costed.join(notes.select("session_id", "step_index", F.col("text").alias("note")), ["session_id", "step_index"], "left")


def _transcripts(steps: DataFrame, notes: DataFrame | None, section: Column, costs: bool) -> DataFrame:
    """session_id, sections in order, totals (a line for each known), notes: a session is the bound of its lists."""
    counters = ("tokens_in", "tokens_out", "cache_read", "cache_create")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    seen = F.array_distinct(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("model").isNotNull(), F.struct("step_index", "model")))), lambda x: x["model"])
    )
    by = (
        _with_note(steps, notes)
        .groupBy("session_id")
        .agg(ordered_list(section).alias("sections"), *sums, F.sum("cost_nano").alias("cost"), seen.alias("models"), F.count("note").alias("notes"))
    )
    known = sum((F.col(c) for c in counters), F.lit(0)) > 0
    tokens = F.concat(
        F.lit("tokens — in: "),
        "tokens_in",
        F.lit(", out: "),
        "tokens_out",
        F.lit(", cache_read: "),
        "cache_read",
        F.lit(", cache_create: "),
        "cache_create",
    )
    cost = (
        F.when(F.col("cost").isNotNull(), F.concat(F.lit("estimated cost: "), _four_digits(F.col("cost")), F.lit(" USD")))
        .when(known, "estimated cost: (no pricing entry for model)")
    )
    lines = [
        F.when(known, tokens),
        F.when(F.size("models") > 0, F.concat(F.lit("models: "), F.array_join("models", ", "))),
        *([cost] if costs else []),
    ]
    totals = F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")
    return by.withColumn("totals", F.when(totals != "", F.concat(totals, F.lit("\n"))).otherwise(""))


def _meta(parts: list[Column], between: str) -> Column:
    return F.concat_ws(between, *parts)


def _tokens(read: str, create: str) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    text = F.concat(
        F.lit("in="),
        zero("tokens_in"),
        F.lit(" out="),
        zero("tokens_out"),
        F.lit(f" {read}="),
        zero("cache_read"),
        F.lit(f" {create}="),
        zero("cache_create"),
    )
    return F.when(F.col("tokens_in").isNotNull() | F.col("tokens_out").isNotNull(), text)


def markdown(steps: DataFrame, notes: DataFrame | None = None, costs: bool = True) -> DataFrame:
    """session_id and a Markdown transcript: totals, then a section per step with its meta line, note and fenced detail."""
    parts = [
        F.concat(F.lit("**Δ**: "), format_duration(F.col("duration_ms"))),
        F.concat(F.lit("**model**: `"), "model", F.lit("`")),
        F.concat(F.lit("**tokens**: "), _tokens("cache_read", "cache_create")),
    ]
    meta = _meta([*parts, *([F.concat(F.lit("**cost**: "), _four_digits(F.col("cost_nano")))] if costs else [])], "  ·  ")
    note = F.concat(F.lit("> **note**: "), F.replace(F.regexp_replace("note", r"\r?\n$", ""), F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"))
    head = F.concat(F.lit("## "), _of_kind(0), F.lit(" — step "), (F.col("step_index") + 1).cast("string"), F.lit(" ("), _of_kind(1), F.lit(")\n\n"))
    ended = F.when(F.col("detail").endswith("\n"), F.col("detail")).otherwise(F.concat("detail", F.lit("\n")))
    section = F.concat(
        head,
        F.when(meta != "", F.concat(meta, F.lit("\n\n"))).otherwise(""),
        F.coalesce(note, F.lit("")),
        F.lit("```\n"),
        ended,
        F.lit("```\n\n"),
    )
    rows = _transcripts(steps, notes, section, costs)
    count = F.when(F.col("notes") > 0, F.concat(F.lit("annotations: "), "notes", F.lit("\n"))).otherwise("")
    return rows.select(
        "session_id",
        F.concat(F.lit("# session transcript\n\n"), "totals", count, F.lit("\n"), F.array_join("sections", "")).alias("document"),
    )


def escape(text: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


#: The page's style: dark, a coloured border per kind of step.
STYLE = """body { font: 14px/1.5 monospace; background: #101014; color: #ddd; padding: 2rem }
.step { margin: 1rem 0; padding: .7rem 1rem; border-left: 3px solid #555 }
.user-text { border-color: cyan } .assistant-text { border-color: lightgreen } .tool-use { border-color: gold } .tool-result { border-color: violet }
.meta { color: #999 } .note { border-left: 3px solid violet; padding-left: .6rem } pre { white-space: pre-wrap }"""


def html_top() -> str:
    """A page up to its totals."""
    head = [
        "<!DOCTYPE html>",
        '<html lang="en"><head>',
        '<meta charset="utf-8">',
        "<title>session</title>",
        "<style>",
        STYLE,
        "</style>",
        "</head><body>",
        "<h1>session transcript</h1>",
        '<div class="totals">',
    ]
    return "\n".join([*head, ""])


def html(steps: DataFrame, notes: DataFrame | None = None, costs: bool = True) -> DataFrame:
    """session_id and an HTML page of the same content, with its style and without scripts."""
    broken = lambda c: F.replace(escape(c), F.lit("\n"), F.lit("<br>\n"))
    parts = [
        F.concat(F.lit("Δ "), format_duration(F.col("duration_ms"))),
        F.concat(F.lit("model <code>"), escape(F.col("model")), F.lit("</code>")),
        F.concat(F.lit("tokens "), _tokens("cache_r", "cache_c")),
    ]
    meta = _meta([*parts, *([F.concat(F.lit("cost "), _four_digits(F.col("cost_nano")))] if costs else [])], " · ")
    kind = F.translate("kind", "_", "-")
    head = F.concat(
        F.lit('<div class="step '),
        kind,
        F.lit('"><h2>step '),
        (F.col("step_index") + 1).cast("string"),
        F.lit(" — "),
        _of_kind(1),
        F.lit("</h2>\n"),
    )
    note = F.concat(F.lit('<div class="note">'), broken(F.col("note")), F.lit("</div>\n"))
    section = F.concat(
        head,
        F.when(meta != "", F.concat(F.lit('<div class="meta">'), meta, F.lit("</div>\n"))).otherwise(""),
        F.coalesce(note, F.lit("")),
        F.lit("<pre>"),
        escape(F.col("detail")),
        F.lit("</pre>\n</div>\n"),
    )
    rows = _transcripts(steps, notes, section, costs)
    count = F.when(F.col("notes") > 0, F.concat(F.lit("<br>annotations: "), "notes", F.lit("\n"))).otherwise("")
    return rows.select(
        "session_id",
        (
            F.concat(F.lit(html_top()), broken(F.col("totals")), count, F.lit("</div>\n"), F.array_join("sections", ""), F.lit("</body></html>\n"))
            .alias("document")
        ),
    )
