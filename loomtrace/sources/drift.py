"""What session files hold that no parser reads: unknown kinds of lines, payloads, content items, runs, steps and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.sources.run_trees import run_list, text_at

#: What the parsers know.
KNOWN = {
    "claude_code": ("user", "assistant"),
    "codex": ("session_meta", "event_msg", "response_item", "turn_context"),
    "gemini": ("user", "gemini"),
    "generic": ("user", "assistant", "tool", "system"),
    "langchain": ("chain", "llm", "chat_model", "tool"),
    "vercel_ai": ("initial", "continue", "tool-result"),
    "otel_json": ("chat", "text_completion", "generate_content", "execute_tool"),
}
KNOWN_PAYLOADS = ("message", "function_call", "function_call_output")
KNOWN_ITEMS = {"user": ("text", "tool_result"), "assistant": ("text", "tool_use")}
#: Positions that a report names.
FIRST = 3


def _items(column: str, path: str) -> Column:
    return F.expr(f"try_variant_get({column}, '{path}', 'array<variant>')")


def _lined(files: DataFrame) -> DataFrame:
    """Lines of the two formats that have a JSON object a line: tag and section of what is unknown."""
    rows = files.filter(F.col("format").isin("claude_code", "codex"))
    lines = (
        rows
        .select("path", "format", F.posexplode(F.split("content", "\n")).alias("i", "line"))
        .filter(F.trim("line", F.lit(" \t\r\x0b\x0c")) != "")
    )
    lines = (
        lines
        .select("path", "format", (F.col("i") + 1).alias("position"), F.expr("try_parse_json(line)").alias("m"))
        .withColumn("type", text_at("m", "$.type"))
    )
    known = F.when(F.col("format") == "codex", F.col("type").isin(*KNOWN["codex"])).otherwise(F.col("type").isin(*KNOWN["claude_code"]))
    top = F.when(F.col("m").isNull(), "<malformed-json>").when(F.col("type").isNull(), "<no-type-field>").when(~known, F.col("type"))
    top = lines.select("path", "format", F.lit("top_level").alias("section"), top.alias("tag"), "position")
    payload = text_at("m", "$.payload.type")
    payloads = (
        lines
        .filter("format = 'codex' and type = 'response_item'")
        .select("path", "format", F.lit("payload").alias("section"), payload.alias("tag"), "position")
        .filter(~F.col("tag").isin(*KNOWN_PAYLOADS))
    )
    item = lines.filter("format = 'claude_code'").select("path", "format", "type", "position", F.explode(_items("m", "$.message.content")).alias("x"))
    item = item.select("path", "format", F.lit("content_item").alias("section"), text_at("x", "$.type").alias("tag"), "position", "type")
    unknown = (
        F.when(F.col("type") == "user", ~F.col("tag").isin(*KNOWN_ITEMS["user"]))
        .when(F.col("type") == "assistant", ~F.col("tag").isin(*KNOWN_ITEMS["assistant"]))
    )
    return top.unionByName(payloads).unionByName(item.filter(unknown).drop("type"))


def _listed(files: DataFrame, fmt: str, items: Column, tag: str) -> DataFrame:
    rows = files.filter(F.col("format") == fmt).withColumn("v", F.expr("try_parse_json(content)"))
    rows = rows.select("path", "format", F.posexplode(items).alias("i", "x"))
    return (
        rows
        .select("path", "format", F.lit("top_level").alias("section"), text_at("x", tag).alias("tag"), (F.col("i") + 1).alias("position"))
        .filter(~F.col("tag").isin(*KNOWN[fmt]))
    )


def _spans(files: DataFrame) -> DataFrame:
    fmt = "otel_json"
    rows = files.filter(F.col("format") == fmt).withColumn("v", F.expr("try_parse_json(content)"))
    rows = (
        rows
        .select("path", F.posexplode(_items("v", "$.resourceSpans")).alias("a", "r"))
        .select("path", "a", F.posexplode(_items("r", "$.scopeSpans")).alias("b", "s"))
    )
    rows = rows.select("path", "a", "b", F.posexplode(_items("s", "$.spans")).alias("c", "x"))
    rows = rows.withColumn("position", F.row_number().over(W.partitionBy("path").orderBy("a", "b", "c")))
    named = F.filter(
        _items("x", "$.attributes"),
        lambda y: (
            (F.try_variant_get(y, "$.key", "string") == "gen_ai.operation.name") & F.try_variant_get(y, "$.value.stringValue", "string").isNotNull()
        ),
    )
    operation = F.try_variant_get(F.get(named, F.size(named) - 1), "$.value.stringValue", "string")
    return (
        rows
        .select("path", F.lit(fmt).alias("format"), F.lit("top_level").alias("section"), operation.alias("tag"), "position")
        .filter(~F.col("tag").isin(*KNOWN[fmt]))
    )


def _runs(files: DataFrame) -> DataFrame:
    rows = files.filter("format = 'langchain'").select("path", "format", F.posexplode(run_list("content")).alias("i", "r"))
    rows = rows.select("path", "format", F.lit("top_level").alias("section"), F.col("r.run_type").alias("tag"), (F.col("i") + 1).alias("position"))
    return rows.filter((F.col("tag") != "") & ~F.col("tag").isin(*KNOWN["langchain"]))


def drift_report(detected: DataFrame) -> DataFrame:
    """path, format, section, tag, count, first_positions: what the files of detect() hold that isn't read, with the first FIRST lines, messages, runs, steps or spans (from 1).

    Files without anything unknown have no row; binary files have one, as they aren't looked into.
    """
    binary = (
        detected
        .filter("format = 'otel_proto'")
        .select("path", "format", F.lit("top_level").alias("section"), F.lit("<binary-otlp-not-scanned>").alias("tag"), F.lit(0).alias("position"))
    )
    parts = [
        _lined(detected), binary, _runs(detected), _spans(detected),
        _listed(detected, "gemini", _items("v", "$.messages"), "$.type"), _listed(detected, "generic", _items("v", "$.messages"), "$.role"), _listed(detected, "vercel_ai", _items("v", "$.steps"), "$.stepType"),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    by = ["path", "format", "section", "tag"]
    found = found.filter("tag is not null").withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("position")))
    first = F.array_sort(F.collect_list(F.when(F.col("n") <= FIRST, F.col("position"))))
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), first.alias("first_positions"))
