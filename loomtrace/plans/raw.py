"""Session files of every format, made from the conversations table, for the queries that read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.sources.adapters import event_parts


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").filter("role in ('user', 'assistant')").withColumn("text", F.coalesce("text", F.lit("")))


def _files(turns: DataFrame, line: Column, content: Column) -> DataFrame:
    """path and content: line of each turn, in order, as column `lines` of content."""
    rows = (
        turns
        .groupBy(F.col("conv_id").cast("string").alias("path"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line"), "role", "text"))).alias("turns"))
    )
    return rows.withColumn("lines", F.transform("turns", lambda t: t["line"])).select("path", content.alias("content"))


def _list(column: str = "lines") -> Column:
    return F.concat(F.lit("["), F.array_join(column, ","), F.lit("]"))


def _first_user() -> Column:
    return F.coalesce(F.get(F.filter("turns", lambda t: t["role"] == "user"), F.lit(0))["text"], F.lit(""))


def generic(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct("role", F.col("text").alias("content")))
    return _files(_turns(spark, d), line, F.concat(F.lit('{"messages":'), _list(), F.lit("}")))


def claude_code(spark: SparkSession, d: str) -> DataFrame:
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    message = F.struct("role", content.alias("content"))
    line = F.to_json(
        F.struct(
            F.col("role").alias("type"),
            F.concat("conv_id", F.lit("-"), "turn").alias("uuid"),
            F.concat(F.lit("p"), "turn").alias("parentUuid"),
            message.alias("message"),
        )
    )
    return _files(_turns(spark, d), line, F.array_join("lines", "\n"))


def codex(spark: SparkSession, d: str) -> DataFrame:
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))
    return _files(_turns(spark, d), line, F.concat(F.lit('{"type":"session_meta"}\n'), F.array_join("lines", "\n")))


def gemini(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct(F.when(F.col("role") == "assistant", "gemini").otherwise("user").alias("type"), F.col("text").alias("content")))
    return _files(_turns(spark, d), line, F.concat(F.lit('{"sessionId":"s","messages":'), _list(), F.lit("}")))


def vercel_ai(spark: SparkSession, d: str) -> DataFrame:
    """Only the first user turn and the assistant's turns have a place in such a file."""
    steps = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.to_json(F.struct(F.lit("continue").alias("stepType"), t["text"].alias("text"))),
    )
    asked = F.to_json(F.struct(F.lit("user").alias("role"), _first_user().alias("content")))
    return _files(
        _turns(spark, d),
        F.lit(None).cast("string"),
        F.concat(F.lit('{"finishReason":"stop","messages":['), asked, F.lit('],"steps":['), F.array_join(steps, ","), F.lit("]}")),
    )


def otel_json(spark: SparkSession, d: str) -> DataFrame:
    attribute = lambda k, v: F.struct(k.alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    section = F.when(F.col("role") == "user", "gen_ai.prompt.0").otherwise("gen_ai.completion.0")
    attributes = F.array(attribute(F.lit("gen_ai.operation.name"), F.lit("chat")), attribute(F.concat(section, F.lit(".content")), F.col("text")))
    line = F.to_json(F.struct(((F.col("turn") + 1) * 1_000_000).cast("string").alias("startTimeUnixNano"), attributes.alias("attributes")))
    return _files(_turns(spark, d), line, F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":'), _list(), F.lit("}]}]}")))


def langchain(spark: SparkSession, d: str) -> DataFrame:
    """As for vercel_ai: the root's question and a model run for each of the assistant's turns."""
    start = lambda t: F.concat(
        F.lit("2024-01-01T00:"),
        F.lpad(F.floor(t["turn"] / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((t["turn"] % 60).cast("string"), 2, "0"),
    )
    said = lambda t: F.array(F.array(F.struct(F.struct(F.struct(t["text"].alias("content")).alias("data")).alias("message"))))
    run = lambda t: F.to_json(
        F.struct(
            F.lit("llm").alias("run_type"),
            F.lit("r").alias("id"),
            F.lit("model").alias("name"),
            start(t).alias("start_time"),
            F.struct(said(t).alias("generations")).alias("outputs"),
        )
    )
    runs = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), run)
    inputs = F.to_json(F.struct(_first_user().alias("question")))
    return _files(
        _turns(spark, d),
        F.lit(None).cast("string"),
        F.concat(F.lit('{"run_type":"chain","id":"root","inputs":'), inputs, F.lit(',"child_runs":['), F.array_join(runs, ","), F.lit("]}")),
    )


FILES = {"claude_code": claude_code, "codex": codex, "gemini": gemini, "vercel_ai": vercel_ai, "otel_json": otel_json, "langchain": langchain}


def event_files(spark: SparkSession, d: str) -> DataFrame:
    """A file per user with a line per event, of kinds that no parser knows; each 50th event is damaged."""
    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.when(F.col("event_id") % 50 == 0, "{cut").otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), "event_id")))
    rows = (
        e
        .groupBy(F.col("user_id").cast("string").alias("path"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    )
    return rows.select("path", F.concat(F.lit('{"type":"assistant","uuid":"a","message":{"role":"assistant","content":[]}}\n'), F.array_join("lines", "\n")).alias("content"))


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """path, lines: a chat per user, from events: text, tool calls with arguments, results by call id, models and usage, a line a message.

    Events move first and are written out as messages where their chat comes together: a file of few
    row groups would leave that to few tasks.
    """
    p = event_parts(spark.read.parquet(f"{d}/events.parquet").repartition(F.col("user_id").cast("string")))
    call = F.struct(F.col("tool_call_id").alias("id"), F.struct(F.col("tool_name").alias("name"), F.col("input_text").alias("arguments")).alias("function"))
    usage = F.struct(F.col("tokens_in").alias("prompt_tokens"), F.col("tokens_out").alias("completion_tokens"), F.col("cache_read").alias("cached_tokens"))
    role = F.when(F.col("kind") == "user_text", "user").when(F.col("kind") == "tool_result", "tool").otherwise("assistant")
    said = F.col("kind") == "assistant_text"
    message = F.struct(
        role.alias("role"), F.coalesce("text", "result_text").alias("content"), F.when(F.col("kind") == "tool_use", F.array(call)).alias("tool_calls"),
        F.when(F.col("kind") == "tool_result", F.col("tool_call_id")).alias("tool_call_id"), F.when(said, F.col("model")).alias("model"), F.when(said, usage).alias("usage"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", F.to_json(message).alias("line")))), lambda x: x["line"])
    return p.groupBy(F.col("session_id").alias("path")).agg(listed.alias("lines"))


def chats(messages: DataFrame, part: str = "n") -> DataFrame:
    """Files of chat_messages(); the first `part` (SQL over n, the number of all) of each chat's messages."""
    kept = F.slice("lines", F.lit(1), F.expr(part).cast("int"))
    rows = messages.withColumn("n", F.size("lines"))
    return rows.select("path", F.concat(F.lit('{"messages":['), F.array_join(kept, ","), F.lit("]}")).alias("content"))


def tool_chats(spark: SparkSession, d: str) -> DataFrame:
    """A whole chat per user, from events."""
    return chats(chat_messages(spark, d))


def _event_lines(spark: SparkSession, d: str, line: Column, head: str = "", between: str = "\n", foot: str = "") -> DataFrame:
    """A file per user with a line per event in order, none where it is null; `line` reads event_parts' columns, role and at (ISO time)."""
    p = event_parts(spark.read.parquet(f"{d}/events.parquet")).withColumns({
        "role": F.when(F.col("kind").isin("user_text", "tool_result"), "user").otherwise("assistant"),
        "at": F.translate(F.expr("cast(timestampadd(MILLISECOND, timestamp_ms, timestamp_ntz'1970-01-01 00:00:00') as string)"), " ", "T"),
    })
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])
    return p.groupBy(F.col("session_id").alias("path")).agg(F.concat(F.lit(head), F.array_join(F.array_compact(listed), between), F.lit(foot)).alias("content"))


def tool_traces(spark: SparkSession, d: str) -> DataFrame:
    """Parent-linked lines from events: text, tool uses, their results, models, usage; events of the same 300 ids share a parent."""
    item = (
        F.when(F.col("kind") == "tool_use", F.concat(F.lit('{"type":"tool_use","id":"'), "tool_call_id", F.lit('","name":"'), "tool_name", F.lit('","input":'), "input_text", F.lit("}")))
        .when(F.col("kind") == "tool_result", F.to_json(F.struct(F.lit("tool_result").alias("type"), F.col("tool_call_id").alias("tool_use_id"), F.col("result_text").alias("content"))))
        .otherwise(F.to_json(F.struct(F.lit("text").alias("type"), "text")))
    )
    usage = F.struct(
        F.col("tokens_in").alias("input_tokens"),
        F.col("tokens_out").alias("output_tokens"),
        F.col("cache_read").alias("cache_read_input_tokens"),
        F.col("cache_create").alias("cache_creation_input_tokens"),
    )
    answered = F.when(F.col("kind") == "assistant_text", F.concat(F.lit(',"model":"'), "model", F.lit('","usage":'), F.to_json(usage))).otherwise("")
    line = F.concat(
        F.lit('{"type":"'), "role", F.lit('","uuid":"e'), "event_id", F.lit('","parentUuid":"p'), F.floor(F.col("event_id") / 300), F.lit('","timestamp":"'), "at",
        F.lit('","message":{"role":"'), "role", F.lit('","content":['), item, F.lit("]"), answered, F.lit("}}"),
    )
    return _event_lines(spark, d, line)


def tool_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Rollout lines from events: messages with models and usage, function calls and their outputs."""
    typed = lambda name, *fields: F.to_json(F.struct(F.lit(name).alias("type"), *fields))
    call_id = F.col("tool_call_id").alias("call_id")
    usage = F.struct(F.col("tokens_in").alias("input_tokens"), F.col("tokens_out").alias("output_tokens"), F.col("cache_read").alias("cached_tokens"))
    said = F.col("kind") == "assistant_text"
    payload = (
        F.when(F.col("kind") == "tool_use", typed("function_call", F.col("tool_name").alias("name"), call_id, F.col("input_text").alias("arguments")))
        .when(F.col("kind") == "tool_result", typed("function_call_output", call_id, F.col("result_text").alias("output")))
        .otherwise(typed("message", "role", F.array(F.struct("text")).alias("content"), F.col("model"), F.when(said, usage).alias("usage")))
    )
    line = F.concat(F.lit('{"type":"response_item","timestamp":"'), "at", F.lit('","payload":'), payload, F.lit("}"))
    return _event_lines(spark, d, line, '{"type":"session_meta"}\n')


def tool_messages(spark: SparkSession, d: str) -> DataFrame:
    """Chats from events whose tool calls hold their results, as a response's output or as plain text; events that are results have no place in them."""
    said = F.col("kind") == "assistant_text"
    done = F.concat(F.lit("done by "), "tool_call_id")
    response = F.array(F.struct(F.struct(F.struct(done.alias("output")).alias("response")).alias("functionResponse")))
    result = F.when(F.col("event_id") % 2 == 0, F.to_json(response)).otherwise(F.concat(F.lit('"'), done, F.lit('"')))
    call = F.concat(F.lit('{"id":"'), "tool_call_id", F.lit('","name":"'), "tool_name", F.lit('","args":'), "input_text", F.lit(',"result":'), result, F.lit("}"))
    usage = F.struct(
        F.col("tokens_in").alias("promptTokenCount"),
        F.col("tokens_out").alias("candidatesTokenCount"),
        F.col("cache_read").alias("cachedContentTokenCount"),
    )
    kind = F.when(F.col("role") == "user", "user").otherwise("gemini").alias("type")
    message = F.to_json(F.struct(kind, F.col("at").alias("timestamp"), F.col("text").alias("content"), "model", F.when(said, usage).alias("usageMetadata")))
    calling = F.concat(F.lit('{"type":"gemini","timestamp":"'), "at", F.lit('","content":"","toolCalls":['), call, F.lit("]}"))
    line = F.when(F.col("kind") == "tool_use", calling).when(F.col("kind") != "tool_result", message)
    return _event_lines(spark, d, line, '{"sessionId":"s","messages":[', ",", "]}")


def sidecars(spark: SparkSession, d: str) -> DataFrame:
    """A sidecar of notes per conversation, on each third turn; those of conversations with numbers divisible by 7 are damaged."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").filter("turn % 3 = 0")
    note = F.struct(
        F.substring("text", 1, 20).alias("text"),
        F.col("turn").cast("long").alias("created_at_ms"),
        (F.col("turn") + 5).cast("long").alias("updated_at_ms"),
    )
    rows = (
        turns
        .filter("text is not null")
        .groupBy("conv_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string"), note)))).alias("notes"))
    )
    whole = F.to_json(F.struct(F.lit(1).alias("version"), F.concat(F.lit("conversation "), "conv_id").alias("path"), "notes"))
    return rows.select(
        F.col("conv_id").cast("string").alias("path"),
        F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("{"), whole)).otherwise(whole).alias("content"),
    )
