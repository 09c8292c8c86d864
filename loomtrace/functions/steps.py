"""Column functions over steps: layouts, previews, errors, cost, times."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


def in_session() -> WindowSpec:
    """Steps of a session, in order."""
    return W.partitionBy("session_id").orderBy("step_index")


STEP_COLUMNS = (
    "session_id string, step_index int, format string, kind string, label string, detail string, tool_name string, tool_call_id string, timestamp_ms long, "
    "duration_ms long, model string, tokens_in long, tokens_out long, cache_read long, cache_create long, is_fork_root boolean, input_text string, result_text string"
)

#: Display names of the formats.
FORMAT_NAMES = {
    "claude_code": "Claude Code",
    "codex": "Codex CLI",
    "gemini": "Gemini CLI",
    "generic": "Generic conversation",
    "langchain": "LangChain / LangSmith",
    "otel_json": "OpenTelemetry GenAI (JSON)",
    "otel_proto": "OpenTelemetry GenAI (protobuf)",
    "vercel_ai": "Vercel AI SDK",
}

#: What marks a failed tool result, besides exit codes.
ERROR_MARKS = ('"error"', "error:", " failed", "\nfailed", "traceback", "panic!", "exception:", "no such file", "permission denied", "command failed")

#: USD per million tokens (model, input, output, cache read, cache create).
RATES = (
    ("claude-opus-4-8", 15.0, 75.0, 1.5, 18.75),
    ("claude-opus-4-6", 15.0, 75.0, 1.5, 18.75),
    ("claude-sonnet-4-6", 3.0, 15.0, 0.3, 3.75),
    ("claude-haiku-4-5", 1.0, 5.0, 0.1, 1.25),
    ("gpt-5", 10.0, 30.0, 2.5, None),
    ("gpt-5-mini", 0.5, 2.0, 0.1, None),
    ("gemini-2-5-pro", 2.5, 15.0, 0.625, None),
    ("gemini-2-5-flash", 0.3, 2.5, 0.075, None),
)


def truncate(text: Column, n: int) -> Column:
    """The first n code points, line breaks as blanks, with an ellipsis if there are more."""
    flat = F.translate(text, "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def short_id(call_id: Column) -> Column:
    return F.when(F.length(call_id) > 12, F.concat(F.substring(call_id, 1, 11), F.lit("…"))).otherwise(call_id)


def label(kind: Column, text: Column, tool: Column, call_id: Column, result: Column) -> Column:
    """The one-line preview of a step."""
    return (
        F.when(kind == "user_text", F.concat(F.lit("[user]   "), truncate(text, 60)))
        .when(kind == "assistant_text", F.concat(F.lit("[asst]   "), truncate(text, 60)))
        .when(kind == "tool_use", F.concat(F.lit("[tool]   "), tool, F.lit(" ("), short_id(call_id), F.lit(")")))
        .otherwise(F.concat(F.lit("[result] "), F.coalesce(tool, F.lit("(unknown)")), F.lit(" → "), truncate(result, 50)))
    )


def detail(kind: Column, text: Column, tool: Column, call_id: Column, input_text: Column, result: Column) -> Column:
    """The full text of a step; tool steps have a fixed layout."""
    head = F.concat(F.lit("Tool: "), F.coalesce(tool, F.lit("(unknown)")), F.lit("\nID: "), call_id, F.lit("\n\n"))
    given = F.coalesce(F.concat(F.lit("Input:\n"), input_text, F.lit("\n\n")), F.lit(""))
    return (
        F.when(kind.isin("user_text", "assistant_text"), text)
        .when(kind == "tool_use", F.concat(head, F.lit("Input:\n"), input_text))
        .otherwise(F.concat(head, given, F.lit("Result:\n"), result))
    )


def is_error(kind: Column, detail_text: Column) -> Column:
    """Whether a tool result reports an error, by marks and exit codes other than 0 (that fit 32 bits)."""
    parts = F.split(detail_text, "\nResult:\n", -1)

    def failed(text: Column) -> Column:
        marks = F.lit(False)
        for mark in ERROR_MARKS:
            marks = marks | F.contains(text, F.lit(mark))
        codes = F.regexp_extract_all(text, F.lit(r"(?:exit code |process exited with code )([0-9]+)"), F.lit(1))
        coded = F.exists(
            codes,
            lambda c: (
                c.rlike("[1-9]") & (F.length(F.regexp_replace(c, "^0+", "")) <= 10) & (F.regexp_replace(c, "^0+", "").cast("decimal(20,0)") <= 4294967295)
            ),
        )
        return marks | coded

    # a list of one gives the text a name: written out, an aggregate would cut and lower it again for each mark
    return (kind == "tool_result") & F.exists(F.array(F.lower(F.coalesce(F.get(parts, F.lit(1)), detail_text))), failed)


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATES), "name string, rate_in double, rate_out double, rate_read double, rate_create double")


def with_cost(steps: DataFrame) -> DataFrame:
    """Adds cost_usd: null for unknown models and where no counter is above 0.

    Counters are multiplied by rates in whole nano-dollars, so sums are exact. The price list has a
    fixed number of rows, hence the broadcast.
    """
    nano = lambda tokens, rate: F.coalesce(tokens, F.lit(0)) * F.round(rate * 1000).cast("long")
    p = F.broadcast(prices(steps.sparkSession))
    cost = (
        nano(F.col("tokens_in"), F.col("rate_in"))
        + nano(F.col("tokens_out"), F.col("rate_out"))
        + nano(F.col("cache_read"), F.coalesce("rate_read", "rate_in"))
        + nano(F.col("cache_create"), F.coalesce("rate_create", "rate_in"))
    )
    used = F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("tokens_in", "tokens_out", "cache_read", "cache_create")]) > 0
    joined = steps.join(p, F.lower(steps["model"]) == p["name"], "left")
    return (
        joined
        .withColumn("cost_nano", F.when(F.col("name").isNotNull() & used, cost))
        .withColumn("cost_usd", F.col("cost_nano") / 1e9)
        .drop("name", "rate_in", "rate_out", "rate_read", "rate_create")
    )


def iso_millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO time; the zone suffix is ignored, the fraction cut to milliseconds."""
    digits = F.regexp_replace(F.substring(text, 1, 19), "[^0-9]", "")
    whole = F.when(F.length(text) >= 19, F.unix_millis(F.try_to_timestamp(F.concat(digits, F.lit("Z")), F.lit("yyyyMMddHHmmssX"))))
    fraction = F.rpad(F.regexp_extract(text, r"^.{19}\.([0-9]{1,3})", 1), 3, "0").cast("long")
    return whole + F.coalesce(F.when(F.get(F.split(text, ""), F.lit(19)) == ".", fraction), F.lit(0))


def input_section(text: Column) -> Column:
    """What follows the first Input mark of a tool step's detail: up to its result, else its first blank line, else its end."""
    at = F.locate("\nInput:\n", text)
    rest = F.substring(text, at + 8, F.length(text))
    result, blank = F.locate("\n\nResult:\n", rest), F.locate("\n\n", rest)
    return F.when(
        at > 0,
        F.when(result > 0, F.substring(rest, F.lit(1), result - 1)).when(blank > 0, F.substring(rest, F.lit(1), blank - 1)).otherwise(rest),
    )


def result_section(text: Column) -> Column:
    at = F.locate("\nResult:\n", text)
    return F.when(at > 0, F.substring(text, at + 9, F.length(text)))


def shell_command(tool: Column, input_text: Column) -> Column:
    """The command of a shell tool's call; null for others, for no JSON and for empty commands."""
    found = F.coalesce(F.get_json_object(input_text, "$.command"), F.get_json_object(input_text, "$.cmd"))
    return F.when(tool.isin("Bash", "bash", "shell", "Shell") & (found != ""), found)


def format_duration(ms: Column) -> Column:
    """Milliseconds, or tenths of seconds or minutes, rounded half up."""
    tenths = lambda unit, name: F.format_string(
        f"%d.%d{name}",
        F.floor(F.floor((ms + unit // 20) / (unit // 10)) / 10),
        F.floor((ms + unit // 20) / (unit // 10)) % 10,
    )
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, tenths(1000, "s")).when(ms >= 60000, tenths(60000, "m"))


def relative_time(seconds: Column, now: Column) -> Column:
    """How long ago a time is; now is a parameter."""
    d = now - seconds
    unit = lambda size, name: F.concat(F.floor(d / size).cast("string"), F.lit(f"{name} ago"))
    return (
        F.when(d.isNull(), "?")
        .when(d < 0, "future")
        .when(d < 60, "just now")
        .when(d < 3600, unit(60, "m"))
        .when(d < 86400, unit(3600, "h"))
        .when(d < 2592000, unit(86400, "d"))
        .otherwise(unit(2592000, "mo"))
    )


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """Indented JSON with sorted keys; what is no JSON stays as it is."""

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(json.loads(x), indent=2, sort_keys=True, ensure_ascii=False) if x else x
        except ValueError:
            return x

    return text.map(one)


def redact(text: Column, needles: list[str]) -> Column:
    """Replaces literal needles one after the other; empty ones are skipped."""
    for needle in needles:
        if needle:
            text = F.replace(text, F.lit(needle), F.lit("[REDACTED]"))
    return text
