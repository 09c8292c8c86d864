"""Run trees (nested runs of chains, models and tools) to raw steps."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.functions.steps import iso_millis, pretty_json

RUN = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("run_type", "id", "name", "start", "inputs", "outputs", "extra")]))


def listed_runs(content: str | None) -> list[dict] | None:
    """All runs of a tree, each before its children; null if this is no tree of runs."""
    try:
        todo, out = [json.loads(content or "")], []
    except ValueError:
        return None
    while todo:
        run = todo.pop()
        if not isinstance(run, dict) or not isinstance(run.get("child_runs", []), list):
            return None
        named = {k: run.get(k, "") for k in ("run_type", "id", "name")}
        if not all(isinstance(x, str) for x in named.values()) or not isinstance(run.get("start_time"), str | None):
            return None
        parts = {k: json.dumps(run.get(k), ensure_ascii=False) for k in ("inputs", "outputs", "extra")}
        out.append({**named, "start": run.get("start_time"), **parts})
        todo += reversed(run.get("child_runs", []))
    return out


@F.pandas_udf(RUN)
def run_list(content: pd.Series) -> pd.Series:
    return content.map(listed_runs)


def text_at(column: str, path: str) -> Column:
    """The string at a path of a variant; null for any other kind of value."""
    value = f"try_variant_get({column}, '{path}', 'variant')"
    return F.expr(f"case when schema_of_variant({value}) = 'STRING' then cast({value} as string) end")


def _json_at(column: str, path: str) -> Column:
    return F.to_json(F.expr(f"try_variant_get({column}, '{path}', 'variant')"))


def langchain(files: DataFrame) -> DataFrame:
    """session_id, position, kind, text, ...: the root's user turn, then runs by start time (missing: 0), stable.

    A model run gives its text and tool calls, a tool run its result, and its call only if the step
    just before isn't a call of the same tool.
    """
    runs = files.select(F.col("path").alias("session_id"), F.posexplode(run_list("content")).alias("n", "r")).select("session_id", "n", "r.*")
    runs = (
        runs
        .withColumns({c: F.expr(f"try_parse_json({c})") for c in ("inputs", "outputs", "extra")})
        .withColumn("timestamp_ms", iso_millis(F.col("start")))
    )
    batches = F.expr("try_variant_get(inputs, '$.messages', 'array<variant>')")
    messages = F.flatten(
        F.transform(batches, lambda b: F.coalesce(F.try_variant_get(b, "$", "array<variant>"), F.expr("cast(array() as array<variant>)")))
    )
    human = F.filter(
        messages,
        lambda m: (F.try_variant_get(m, "$.type", "string") == "human") & F.try_variant_get(m, "$.data.content", "string").isNotNull(),
    )
    first_human = F.try_variant_get(F.get(human, F.lit(0)), "$.data.content", "string")
    asked = F.coalesce(*[text_at("inputs", f"$.{k}") for k in ("input", "question", "query", "prompt")], first_human)
    user = (
        runs
        .filter("n = 0")
        .select("session_id", "timestamp_ms", F.lit("user_text").alias("kind"), asked.alias("text"), F.array(*[F.lit(-1)] * 3).alias("position"))
        .filter("trim(text) <> ''")
    )

    order = W.partitionBy("session_id").orderBy(F.coalesce("timestamp_ms", F.lit(0)), "n")
    said = "$.generations[0][0].message.data"
    calls = F.coalesce(F.expr(f"try_variant_get(outputs, '{said}.tool_calls', 'array<variant>')"), F.expr("cast(array() as array<variant>)"))
    runs = runs.withColumns(
        {
            "k": F.row_number().over(order),
            "said": F.when(F.col("run_type").isin("chat_model", "llm"), text_at("outputs", f"{said}.content")),
            "calls": F.when(F.col("run_type").isin("chat_model", "llm"), calls),
        }
    )
    runs = runs.withColumn("said", F.when(F.trim("said") != "", F.col("said")))
    last_call = F.coalesce(F.try_variant_get(F.get("calls", F.size("calls") - 1), "$.name", "string"), F.lit("(unknown)"))
    emits = runs.filter("run_type = 'tool' or said is not null or size(calls) > 0")
    emits = emits.withColumn("before", F.lag(F.when(F.size("calls") > 0, last_call)).over(order))
    base = ["session_id", "k", "timestamp_ms"]

    model = F.coalesce(
        text_at("outputs", "$.llm_output.model_name"),
        text_at("extra", "$.invocation_params.model_name"),
        text_at("extra", "$.invocation_params.model"),
    )
    number = lambda *keys: F.coalesce(*[F.expr(f"try_variant_get(outputs, '$.llm_output.token_usage.{k}', 'bigint')") for k in keys])
    usage = {
        "model": model,
        "tokens_in": number("prompt_tokens", "input_tokens"),
        "tokens_out": number("completion_tokens", "output_tokens"),
        "cache_read": number("prompt_cache_read", "cache_read_tokens"),
    }
    models = emits.filter("run_type <> 'tool'").withColumns(usage)
    text = (
        models
        .filter("said is not null")
        .select(*base, F.lit("assistant_text").alias("kind"), F.col("said").alias("text"), F.lit(0).alias("j"), *usage)
    )
    used = models.select(*base, "said", *usage, F.posexplode("calls").alias("c", "call"))
    anchor = (F.col("c") == 0) & F.col("said").isNull()
    used = used.select(
        *base,
        F.lit("tool_use").alias("kind"),
        (F.col("c") + 1).alias("j"),
        *[F.when(anchor, F.col(u)).alias(u) for u in usage],
        F.coalesce(text_at("call", "$.name"), F.lit("(unknown)")).alias("tool_name"),
        F.coalesce(text_at("call", "$.id"), F.lit("")).alias("tool_call_id"),
        pretty_json(F.coalesce(_json_at("call", "$.args"), F.lit("null"))).alias("input_text"),
    )

    given = pretty_json(F.coalesce(_json_at("inputs", "$.input"), _json_at("inputs", "$.args"), F.to_json("inputs"), F.lit("null")))
    got = F.coalesce(
        text_at("outputs", "$.output"),
        pretty_json(_json_at("outputs", "$.output")),
        text_at("outputs", "$"),
        F.when(F.is_variant_null("outputs"), "").otherwise(pretty_json(F.to_json("outputs"))),
    )
    name = F.when(F.col("name") == "", "(unknown)").otherwise(F.col("name"))
    tools = (
        emits
        .filter("run_type = 'tool'")
        .select(*base, name.alias("tool_name"), F.col("id").alias("tool_call_id"), given.alias("input_text"), got.alias("result_text"), "before")
    )
    own_use = (
        tools
        .filter(~F.coalesce(F.col("before") == F.col("tool_name"), F.lit(False)))
        .select(*base, F.lit("tool_use").alias("kind"), F.lit(0).alias("j"), "tool_name", "tool_call_id", "input_text")
    )
    result = tools.select(*base, F.lit("tool_result").alias("kind"), F.lit(1).alias("j"), "tool_name", "tool_call_id", "input_text", "result_text")

    steps = text
    for part in (used, own_use, result):
        steps = steps.unionByName(part, allowMissingColumns=True)
    steps = steps.withColumn("position", F.array("k", "j", F.lit(0))).drop("k", "j")
    return steps.unionByName(user, allowMissingColumns=True)
