"""Session files in several formats to steps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.steps import STEP_COLUMNS, iso_millis, pretty_json
from loomtrace.operators.sessions import paired
from loomtrace.operators.storage import stored
from loomtrace.sources.adapters import finish
from loomtrace.sources.fields import RULES, fits_all, text_at
from loomtrace.sources.listing import list_files
from loomtrace.sources.run_trees import langchain, run_list

#: Columns of raw steps, before results are paired and steps numbered.
PARTS = {n: t for n, t in (x.split() for x in STEP_COLUMNS.split(", ")) if n in ("session_id", "kind", "tool_name", "tool_call_id", "timestamp_ms", "model", "tokens_in", "tokens_out", "cache_read", "cache_create", "is_fork_root", "input_text", "result_text")} | {"text": "string", "position": "array<int>"}


def read_files(spark: SparkSession, folder: str, max_depth: int = 8) -> DataFrame:
    """path, content (binary), mtime_secs of all files down to max_depth levels (the folder itself is level 1).

    Files are listed first, without folders that can't be, and only those are read.
    """
    paths = list_files(spark, folder, max_depth)
    if not paths:
        return spark.createDataFrame([], "path string, content binary, mtime_secs long")
    # the paths are whole names, not patterns
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("__globPaths__", False).load(paths)
    return files.select("path", "content", F.floor(F.unix_millis("modificationTime") / 1000).alias("mtime_secs"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once a row.

    Spark writes plain columns out wherever later columns and filters name them, and so would parse a
    file again for each mention; it doesn't look through a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def detect(files: DataFrame) -> DataFrame:
    """Adds format (null where nothing fits), status (ok, skip, error) and error to files (path, content); content becomes text.

    A file of lines whose format is known fails as a whole if one line that isn't blank lacks a field that
    its kind of entry needs, or has one of a wrong kind; a chat, if its messages are no list of such
    messages; a run tree, if it is no tree of runs.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = _once(files.withColumn("bad_text", text.isNull()).withColumn("content", text), "v", F.expr("try_parse_json(content)"))
    has = lambda path, kind="variant": F.expr(f"try_variant_get(v, '$.{path}', '{kind}')").isNotNull()
    steps = F.expr("try_variant_get(v, '$.steps', 'array<variant>')")
    calls = F.expr("try_variant_get(v, '$.toolCalls', 'array<variant>')")
    vercel = (
        has("finishReason")
        | F.coalesce(F.exists(steps, lambda s: F.try_variant_get(s, "$.stepType", "variant").isNotNull()), F.lit(False))
        | F.coalesce(
            F.exists(
                calls,
                lambda c: F.try_variant_get(c, "$.toolCallId", "variant").isNotNull() & F.try_variant_get(c, "$.toolName", "variant").isNotNull(),
            ),
            F.lit(False),
        )
    )
    first = F.get(F.filter(F.split("content", "\n"), lambda line: F.trim(line, F.lit(BLANK)) != ""), F.lit(0))
    kind = F.get_json_object(first, "$.type")
    fmt = (
        F.when(F.col("bad_text"), "otel_proto")
        .when(has("resourceSpans"), "otel_json")
        .when(has("run_type") & (has("inputs") | has("outputs")), "langchain")
        .when(vercel, "vercel_ai")
        .when(has("sessionId") & has("messages"), "gemini")
        .when(has("messages"), "generic")
        .when(kind.isin("session_meta", "event_msg", "response_item", "turn_context"), "codex")
        .when(kind.isNotNull(), "claude_code")
    )
    rows = _once(rows, "format", fmt)
    lines = F.filter(
        F.transform(F.split("content", "\n"), lambda line, i: F.struct(line.alias("line"), (i + 1).alias("n"))),
        lambda x: F.trim(x["line"], F.lit(BLANK)) != "",
    )
    parsed = F.transform(lines, lambda x: F.struct(F.try_parse_json(x["line"]).alias("m"), x["n"].alias("n")))  # each line once
    # the format is asked outside of the loop over lines: inside, a filter on status would work it out from the whole file for each line
    bad_line = lambda name: F.get(F.filter(parsed, lambda x: ~_is_entry(x["m"], name)), F.lit(0))["n"]
    numbered_line = lambda name: F.concat(F.lit("parsing line "), bad_line(name), F.lit(" of session file"))
    items = lambda name: F.expr(f"try_variant_get(v, '$.{name}', 'array<variant>')")
    fmt = F.col("format")
    listed = F.when(fmt == "generic", fits_all(items("messages"), RULES["generic"])).when(fmt == "gemini", fits_all(items("messages"), RULES["gemini"]))
    spans = F.when(fmt == "otel_json", fits_all(items("resourceSpans"), RULES["otel_json"]))
    error = (
        F.when(fmt == "codex", numbered_line("codex"))
        .when(fmt == "claude_code", numbered_line("claude_code"))
        .when(~listed, "messages is no list of messages")
        .when(~spans, "resourceSpans is no list of spans")
    )
    error = error.when((fmt == "langchain") & F.col("no_tree"), "parsing run tree")
    rows = rows.withColumn("no_tree", run_list(F.when(fmt == "langchain", F.col("content"))).isNull())
    rows = _once(rows, "error", error)
    return (
        rows
        .withColumn(
            "status",
            F.when(F.col("format").isNull() | (F.col("format") == "otel_proto"), "skip").when(F.col("error").isNotNull(), "error").otherwise("ok"),
        )
        .drop("bad_text", "no_tree")
    )


#: Fixed value: a call without a name.
UNNAMED = "(unknown)"
#: White space that may fill a blank line.
BLANK = " \t\r\x0b\x0c"


def _kind(m: Column, path: str) -> Column:
    """The kind of the value at a path, as schema_of_variant names it: STRING, BIGINT, VOID (null), ...; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(m, path, "variant"))


def _is(m: Column, path: str, *kinds: str) -> Column:
    return F.coalesce(_kind(m, path).isin(*kinds), F.lit(False))


def _may_be(m: Column, path: str, kind: str) -> Column:
    return F.coalesce(_kind(m, path).isin(kind, "VOID"), F.lit(True))


def _items(m: Column, path: str) -> Column:
    return F.try_variant_get(m, path, "array<variant>")


def _is_item(x: Column, said_by: str) -> Column:
    """Whether an item of a message's content has the fields of its type; items of other types may have any."""
    kind = F.try_variant_get(x, "$.type", "string")
    result = _is(x, "$.tool_use_id", "STRING") & (_is(x, "$.content", "STRING") | _items(x, "$.content").isNotNull())
    use = _is(x, "$.id", "STRING") & _is(x, "$.name", "STRING") & F.try_variant_get(x, "$.input", "variant").isNotNull()
    named = (kind == "tool_result", result) if said_by == "user" else (kind == "tool_use", use)
    return _is(x, "$.type", "STRING") & F.when(kind == "text", _is(x, "$.text", "STRING")).when(*named).otherwise(True)


def _is_entry(m: Column, fmt: str) -> Column:
    """Whether a parsed line has what each entry of its format needs, with values of the right kinds."""
    kind = F.try_variant_get(m, "$.type", "string")
    message = _is(m, "$.uuid", "STRING") & _may_be(m, "$.parentUuid", "STRING") & _is(m, "$.message.role", "STRING")
    listed = lambda who: F.coalesce(F.forall(_items(m, "$.message.content"), lambda x: _is_item(x, who)), F.lit(False))
    asked = _is(m, "$.message.content", "STRING") | listed("user")
    counters = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    used = _may_be(m, "$.message.model", "STRING")
    for c in counters:
        used = used & _may_be(m, f"$.message.usage.{c}", "BIGINT")
    entry = F.when(kind == "user", message & asked).when(kind == "assistant", message & listed("assistant") & used).otherwise(True)
    at = _may_be(m, "$.timestamp", "STRING")
    fits = at if fmt == "codex" else entry & F.when(kind.isin("user", "assistant"), at).otherwise(True)
    return F.coalesce(m.isNotNull() & _is(m, "$.type", "STRING") & fits, F.lit(False))


def parse_errors(files: DataFrame) -> DataFrame:
    """path, error of the session files (path, content) whose format is known but which can't be parsed."""
    return detect(files).filter("status = 'error'").select("path", "error")


def _parts(df: DataFrame) -> DataFrame:
    """Raw steps with all columns; missing ones are null."""
    return df.select(
        *[(F.col(n) if n in df.columns else F.lit(False) if n == "is_fork_root" else F.lit(None)).cast(t).alias(n) for n, t in PARTS.items()],
    )


def _get(column: str, path: str, kind: str = "string"):
    return F.expr(f"try_variant_get({column}, '$.{path}', '{kind}')")


def _content(column: str, name: str = "content", part: str = "type"):
    """A message's text: a string, or its text parts joined by line breaks."""
    items = F.expr(f"try_variant_get({column}, '$.{name}', 'array<variant>')")
    if part == "type":
        items = F.filter(items, lambda x: F.try_variant_get(x, "$.type", "string") == "text")
    parts = F.transform(items, lambda x: F.try_variant_get(x, "$.text", "string"))
    return F.when(items.isNotNull(), F.array_join(parts, "\n")).otherwise(F.coalesce(_get(column, name), F.lit("")))


def _array(column: str, path: str):
    return F.coalesce(F.expr(f"try_variant_get({column}, '$.{path}', 'array<variant>')"), F.expr("cast(array() as array<variant>)"))


def generic(files: DataFrame) -> DataFrame:
    """OpenAI-style conversations: user, assistant and tool messages; results pair by id.

    Each message is read once and gives the list of its steps; model and counters are those of an
    assistant's first step.
    """
    m = files.select(F.col("path").alias("session_id"), F.posexplode(_array("v", "messages")).alias("i", "m"))
    m = m.select("session_id", "i", "m", _get("m", "role").alias("role"), _content("m").alias("text"))
    asst, said = F.col("role") == "assistant", F.col("role").isin("user", "assistant") & (F.trim("text") != "")
    none = F.expr("cast(array() as array<struct<j: int, c: variant>>)")
    whole = F.array(F.struct(F.lit(0).alias("j"), F.lit(None).cast("variant").alias("c")))
    calls = F.transform(_array("m", "tool_calls"), lambda c, j: F.struct((j + 1).alias("j"), c.alias("c")))
    steps = F.concat(F.when(said | (F.col("role") == "tool"), whole).otherwise(none), F.when(asst, calls).otherwise(none))
    rows = m.select("session_id", "i", "m", "role", "text", F.posexplode(steps).alias("k", "x")).select("*", F.col("x.j").alias("j"), F.col("x.c").alias("c"))
    use, result = F.col("j") > 0, F.col("role") == "tool"
    first = (F.col("k") == 0) & (F.col("role") == "assistant")
    usage = {"tokens_in": "usage.prompt_tokens", "tokens_out": "usage.completion_tokens", "cache_read": "usage.cached_tokens"}
    return _parts(
        rows.select(
            "session_id",
            F.array("i", "j").alias("position"),
            F.when(use, "tool_use").when(result, "tool_result").otherwise(F.concat("role", F.lit("_text"))).alias("kind"),
            F.when(~use & ~result, F.col("text")).alias("text"),
            F.when(result, F.col("text")).alias("result_text"),
            F.when(use, F.coalesce(_get("c", "function.name"), F.lit(""))).alias("tool_name"),
            F.when(use, F.coalesce(_get("c", "id"), F.lit(""))).when(result, F.coalesce(_get("m", "tool_call_id"), F.lit(""))).alias("tool_call_id"),
            pretty_json(F.when(use, F.coalesce(_get("c", "function.arguments"), F.lit("")))).alias("input_text"),
            F.when(first, _get("m", "model")).alias("model"),
            *[F.when(first, _get("m", path, "bigint")).alias(name) for name, path in usage.items()],
        )
    )


def _anchored(said: DataFrame, usage: dict[str, str], model: str = "model") -> DataFrame:
    """Model and counters on the first step that an assistant message emits; said has i, m, role, position."""
    from pyspark.sql import Window as W

    first = (F.row_number().over(W.partitionBy("session_id", "i").orderBy("position")) == 1) & (F.col("role") == "assistant")
    return (
        said
        .withColumns({"model": F.when(first, _get("m", model)), **{n: F.when(first, _get("m", p, "bigint")) for n, p in usage.items()}})
        .drop("i", "m", "role")
    )


def gemini(files: DataFrame) -> DataFrame:
    """Chats whose messages carry atomic tool calls; each call is a use and a result."""
    m = files.select(F.col("path").alias("session_id"), F.posexplode(_array("v", "messages")).alias("i", "m"))
    m = m.select(
        "session_id",
        "i",
        "m",
        _get("m", "type").alias("type"),
        _content("m", part="").alias("text"),
        iso_millis(_get("m", "timestamp")).alias("ts"),
    )
    role = F.when(F.col("type") == "gemini", "assistant").otherwise(F.col("type"))
    text = (
        m
        .filter("type in ('user', 'gemini') and trim(text) <> ''")
        .select(
            "session_id",
            F.array("i", F.lit(0), F.lit(0)).alias("position"),
            F.concat(role, F.lit("_text")).alias("kind"),
            "text",
            F.col("ts").alias("timestamp_ms"),
            "i",
            "m",
            role.alias("role"),
        )
    )
    calls = m.filter("type = 'gemini'").select("session_id", "i", "m", "ts", F.posexplode(_array("m", "toolCalls")).alias("j", "c"))
    output = F.expr("try_variant_get(c, '$.result[0].functionResponse.response.output', 'string')")
    whole = F.expr("try_variant_get(c, '$.result', 'string')")
    both = calls.select(
        "session_id", "i", "m", "j", F.coalesce(_get("c", "name"), F.lit("")).alias("tool_name"), F.coalesce(_get("c", "id"), F.lit("")).alias("tool_call_id"), pretty_json(F.coalesce(F.to_json(F.expr("try_variant_get(c, '$.args', 'variant')")), F.lit("null"))).alias("input_text"),
        F.coalesce(output, whole, pretty_json(F.to_json(F.expr("try_variant_get(c, '$.result', 'variant')"))), F.lit("")).alias("result"), F.coalesce(iso_millis(_get("c", "timestamp")), "ts").alias("timestamp_ms"), F.explode(F.array(F.lit("tool_use"), F.lit("tool_result"))).alias("kind"),
    )
    both = (
        both
        .withColumn("position", F.array(F.col("i"), F.col("j") + 1, (F.col("kind") == "tool_result").cast("int")))
        .withColumn("result_text", F.when(F.col("kind") == "tool_result", F.col("result")))
        .withColumn("role", F.lit("assistant"))
        .drop("j", "result")
    )
    said = text.unionByName(both, allowMissingColumns=True)
    return _parts(
        _anchored(
            said,
            {
                "tokens_in": "usageMetadata.promptTokenCount",
                "tokens_out": "usageMetadata.candidatesTokenCount",
                "cache_read": "usageMetadata.cachedContentTokenCount",
            },
        )
    )


def _lines(files: DataFrame) -> DataFrame:
    rows = (
        files
        .select(F.col("path").alias("session_id"), F.posexplode(F.split("content", "\n")).alias("i", "line"))
        .filter(F.trim("line", F.lit(BLANK)) != "")
    )
    return rows.select("session_id", "i", F.expr("try_parse_json(line)").alias("m"))


def codex(files: DataFrame) -> DataFrame:
    """Rollout lines: messages of users and assistants, function calls and their outputs, paired by call id."""
    items = _lines(files).filter(_get("m", "type") == "response_item")
    items = (
        items
        .select(
            "session_id",
            "i",
            F.expr("try_variant_get(m, '$.payload', 'variant')").alias("p"),
            iso_millis(_get("m", "timestamp")).alias("timestamp_ms"),
        )
        .withColumn("type", _get("p", "type"))
    )
    position = F.array("i").alias("position")
    texts = F.transform(_array("p", "content"), lambda x: F.try_variant_get(x, "$.text", "string"))
    said = (
        items
        .filter("type = 'message'")
        .select("session_id", position, "timestamp_ms", _get("p", "role").alias("role"), F.array_join(texts, "\n").alias("text"), "p")
        .filter("role in ('user', 'assistant') and trim(text) <> ''")
    )
    asst = F.col("role") == "assistant"
    number = lambda *keys: F.when(asst, F.coalesce(*[_get("p", f"usage.{k}", "bigint") for k in keys]))
    said = (
        said
        .withColumns(
            {
                "kind": F.concat("role", F.lit("_text")),
                "model": F.when(asst, _get("p", "model")),
                "tokens_in": number("input_tokens", "prompt_tokens", "promptTokens"),
                "tokens_out": number("output_tokens", "completion_tokens", "completionTokens"),
                "cache_read": number("cached_tokens", "prompt_cache_read_tokens"),
            }
        )
        .drop("role", "p")
    )
    call_id = F.coalesce(_get("p", "call_id"), F.lit("")).alias("tool_call_id")
    use = (
        items
        .filter("type = 'function_call'")
        .select(
            "session_id",
            position,
            "timestamp_ms",
            F.lit("tool_use").alias("kind"),
            F.coalesce(_get("p", "name"), F.lit("(unknown)")).alias("tool_name"),
            call_id,
            pretty_json(F.coalesce(_get("p", "arguments"), F.lit(""))).alias("input_text"),
        )
    )
    output = F.coalesce(_get("p", "output"), F.to_json(F.expr("try_variant_get(p, '$.output', 'variant')")), F.lit("null"))
    result = (
        items
        .filter("type = 'function_call_output'")
        .select("session_id", position, "timestamp_ms", F.lit("tool_result").alias("kind"), call_id, output.alias("result_text"))
    )
    return _parts(said.unionByName(use, allowMissingColumns=True).unionByName(result, allowMissingColumns=True))


def claude_code(files: DataFrame) -> DataFrame:
    """Parent-linked lines: text, tool uses and tool results of users and assistants; fork roots by shared parents."""
    from pyspark.sql import Window as W

    entries = _lines(files).withColumn("role", _get("m", "type")).filter("role in ('user', 'assistant')")
    entries = entries.select(
        "session_id",
        "i",
        "role",
        F.expr("try_variant_get(m, '$.message', 'variant')").alias("m"),
        iso_millis(_get("m", "timestamp")).alias("timestamp_ms"),
        _get("m", "parentUuid").alias("parent"),
    )
    entries = entries.withColumn("forked", F.count(F.lit(1)).over(W.partitionBy("session_id", "parent")) > 1)
    text_item = F.expr("array(parse_json(to_json(named_struct('type', 'text', 'text', try_variant_get(m, '$.content', 'string')))))")
    items = F.coalesce(F.expr("try_variant_get(m, '$.content', 'array<variant>')"), text_item)
    rows = (
        entries
        .select("*", F.posexplode(items).alias("j", "c"))
        .withColumn("type", _get("c", "type"))
        .withColumn("text", F.when(F.col("type") == "text", _get("c", "text")))
    )
    kept = rows.filter(
        "(type = 'text' and text is not null) or (type = 'tool_use' and role = 'assistant') or (type = 'tool_result' and role = 'user')"
    )
    content = F.expr("try_variant_get(c, '$.content', 'array<variant>')")
    whole = pretty_json(F.when(content.isNotNull(), F.to_json(F.expr("try_variant_get(c, '$.content', 'variant')"))))
    result = F.coalesce(whole, _get("c", "content"), F.lit(""))
    use, res = F.col("type") == "tool_use", F.col("type") == "tool_result"
    steps = kept.select(
        "session_id", "i", "m", "role", F.array("i", "j").alias("position"), "timestamp_ms", F.when(use | res, F.col("type")).otherwise(F.concat("role", F.lit("_text"))).alias("kind"), "text", F.when(use, _get("c", "name")).alias("tool_name"),
        F.when(use, _get("c", "id")).when(res, _get("c", "tool_use_id")).alias("tool_call_id"), F.when(use, pretty_json(F.to_json(F.expr("try_variant_get(c, '$.input', 'variant')")))).alias("input_text"), F.when(res, result).alias("result_text"),
        (F.col("forked") & (F.row_number().over(W.partitionBy("session_id", "i").orderBy("j")) == 1)).alias("is_fork_root"),
    )
    return _parts(
        _anchored(
            steps,
            {
                "tokens_in": "usage.input_tokens",
                "tokens_out": "usage.output_tokens",
                "cache_read": "usage.cache_read_input_tokens",
                "cache_create": "usage.cache_creation_input_tokens",
            },
        )
    )


def vercel_ai(files: DataFrame) -> DataFrame:
    """Multi-step generation results: the user's prompt, then text, calls and results of each step (or of the root alone)."""
    roots = files.select(F.col("path").alias("session_id"), "v")
    users = F.filter(_array("v", "messages"), lambda x: F.try_variant_get(x, "$.role", "string") == "user")
    prompt = F.trim(F.coalesce(_get("v", "prompt"), F.try_variant_get(F.get(users, F.lit(0)), "$.content", "string"), F.lit("")))
    asked = (
        roots
        .select("session_id", F.array(F.lit(-1), F.lit(0), F.lit(0)).alias("position"), F.lit("user_text").alias("kind"), prompt.alias("text"))
        .filter("text <> ''")
    )
    steps = roots.select(
        "session_id",
        _get("v", "response.modelId").alias("root_model"),
        F.posexplode(F.coalesce(F.expr("try_variant_get(v, '$.steps', 'array<variant>')"), F.array("v"))).alias("i", "m"),
    )
    steps = steps.withColumn("timestamp_ms", iso_millis(_get("m", "response.timestamp")))
    base = ["session_id", "i", "m", "root_model", "timestamp_ms"]
    text = (
        steps
        .select(
            *base,
            F.lit(0).alias("s"),
            F.lit(0).alias("j"),
            F.lit("assistant_text").alias("kind"),
            F.trim(F.coalesce(_get("m", "text"), F.lit(""))).alias("text"),
        )
        .filter("text <> ''")
    )
    json = lambda *names: pretty_json(F.coalesce(*[F.to_json(F.expr(f"try_variant_get(c, '$.{n}', 'variant')")) for n in names], F.lit("null")))
    use = (
        steps
        .select(*base, F.lit(1).alias("s"), F.posexplode(_array("m", "toolCalls")).alias("j", "c"))
        .select(
            *base,
            "s",
            "j",
            F.lit("tool_use").alias("kind"),
            F.coalesce(text_at(F.col("c"), "$.toolName"), F.lit(UNNAMED)).alias("tool_name"),
            F.coalesce(text_at(F.col("c"), "$.toolCallId"), F.lit("")).alias("tool_call_id"),
            json("args", "input").alias("input_text"),
        )
    )
    shown = F.coalesce(_get("c", "result"), _get("c", "output"), json("result", "output"))
    result = (
        steps
        .select(*base, F.lit(2).alias("s"), F.posexplode(_array("m", "toolResults")).alias("j", "c"))
        .select(
            *base,
            "s",
            "j",
            F.lit("tool_result").alias("kind"),
            F.coalesce(text_at(F.col("c"), "$.toolName"), F.lit(UNNAMED)).alias("tool_name"),
            F.coalesce(text_at(F.col("c"), "$.toolCallId"), F.lit("")).alias("tool_call_id"),
            json("args", "input").alias("input_text"),
            shown.alias("result_text"),
        )
    )
    said = (
        text
        .unionByName(use, allowMissingColumns=True)
        .unionByName(result, allowMissingColumns=True)
        .withColumn("position", F.array("i", "s", "j"))
        .withColumn("role", F.lit("assistant"))
    )
    model = F.col("root_model")
    out = _anchored(
        said,
        {
            "tokens_in": "usage.promptTokens",
            "tokens_out": "usage.completionTokens",
            "_in": "usage.inputTokens",
            "_out": "usage.outputTokens",
            "cache_read": "usage.cachedInputTokens",
            "_any": "usage.totalTokens",
        },
        "response.modelId",
    )
    zero = (F.coalesce("tokens_in", "_in", F.lit(0)) + F.coalesce("tokens_out", "_out", F.lit(0))) == 0
    out = out.withColumns({"tokens_in": F.when(~zero, F.coalesce("tokens_in", "_in")), "tokens_out": F.when(~zero, F.coalesce("tokens_out", "_out"))})
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("session_id", F.get("position", F.lit(0))).orderBy("position")) == 1
    return _parts(out.withColumn("model", F.when(first, F.coalesce("model", model))).unionByName(asked, allowMissingColumns=True))


def otel_json(files: DataFrame) -> DataFrame:
    """OTel GenAI spans by start time: tool executions, and the numbered prompts and completions of other operations."""
    from pyspark.sql import Window as W

    s = (
        files
        .select(F.col("path").alias("session_id"), F.posexplode(_array("v", "resourceSpans")).alias("a", "r"))
        .select("session_id", "a", F.posexplode(_array("r", "scopeSpans")).alias("b", "s"))
        .select("session_id", "a", "b", F.posexplode(_array("s", "spans")).alias("c", "s"))
    )
    value = lambda x: F.coalesce(
        *[F.try_variant_get(x, f"$.value.{k}", "string") for k in ("stringValue", "intValue", "doubleValue", "boolValue")],
        F.lit(""),
    )
    attrs = F.transform(
        _array("s", "attributes"),
        lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.key", "string"), F.lit("")).alias("k"), value(x).alias("v")),
    )
    last = F.map_from_entries(
        F.filter(attrs, lambda x, i: ~F.exists(F.slice(attrs, i + 2, F.greatest(F.size(attrs), F.lit(1))), lambda y: y["k"] == x["k"]))
    )
    start = F.coalesce(_get("s", "startTimeUnixNano", "bigint"), F.lit(0))
    s = s.select("session_id", "a", "b", "c", start.alias("ns"), last.alias("at")).filter(F.col("at")["gen_ai.operation.name"].isNotNull())
    s = (
        s
        .withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy("ns", "a", "b", "c")))
        .withColumn("timestamp_ms", F.when(F.col("ns") > 0, F.floor(F.col("ns") / 1000000)))
    )
    at = lambda k: F.col("at")[k]
    tool = s.filter(at("gen_ai.operation.name") == "execute_tool")
    base = ["session_id", "n", "timestamp_ms"]
    named = [
        F.coalesce(at("gen_ai.tool.name"), F.lit("(unknown)")).alias("tool_name"),
        F.coalesce(at("gen_ai.tool.call.id"), F.lit("")).alias("tool_call_id"),
        pretty_json(F.coalesce(at("gen_ai.tool.call.arguments"), F.lit(""))).alias("input_text"),
    ]
    use = tool.select(*base, F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit("tool_use").alias("kind"), *named)
    result = (
        tool
        .filter(at("gen_ai.tool.call.result").isNotNull())
        .select(
            *base,
            F.lit(1).alias("x"),
            F.lit(0).alias("y"),
            F.lit("tool_result").alias("kind"),
            *named,
            at("gen_ai.tool.call.result").alias("result_text"),
        )
    )
    pattern = r"^gen_ai\.(prompt|completion)\.([0-9]+)\.content$"
    chat = s.filter(at("gen_ai.operation.name") != "execute_tool").select("*", F.explode("at").alias("k", "text")).filter(F.col("k").rlike(pattern))
    section, number = F.regexp_extract("k", pattern, 1), F.regexp_extract("k", pattern, 2)
    chat = (
        chat
        .withColumns({"section": section, "y": number.cast("int"), "text": F.trim("text")})
        .withColumn(
            "role",
            F.coalesce(
                F.col("at")[F.concat(F.lit("gen_ai."), section, F.lit("."), number, F.lit(".role"))],
                F.when(section == "prompt", "user").otherwise("assistant"),
            ),
        )
    )
    chat = chat.filter("text <> '' and role in ('user', 'assistant')").withColumn("x", (F.col("section") == "completion").cast("int"))
    first = (F.col("section") == "completion") & (F.row_number().over(W.partitionBy("session_id", "n", "section").orderBy("y")) == 1)
    chat = chat.select(
        *base,
        "x",
        "y",
        F.concat("role", F.lit("_text")).alias("kind"),
        "text",
        F.when(first, F.coalesce(at("gen_ai.response.model"), at("gen_ai.request.model"))).alias("model"),
        F.when(first, F.expr("try_cast(at['gen_ai.usage.input_tokens'] as bigint)")).alias("tokens_in"),
        F.when(first, F.expr("try_cast(at['gen_ai.usage.output_tokens'] as bigint)")).alias("tokens_out"),
    )
    return _parts(
        chat
        .unionByName(use, allowMissingColumns=True)
        .unionByName(result, allowMissingColumns=True)
        .withColumn("position", F.array("n", "x", "y").cast("array<int>"))
    )


#: Formats whose results carry only a call id.
PAIRED = {"generic": generic, "codex": codex, "claude_code": claude_code}
NAMED = {"gemini": gemini, "vercel_ai": vercel_ai, "otel_json": otel_json, "langchain": lambda files: _parts(langchain(files))}


def detected(files: DataFrame) -> DataFrame:
    """path, content, format of the session files (path, content) that can be parsed, laid down by format."""
    return stored(detect(files).filter("status = 'ok'").select("path", "content", "format"), "sessions", by="format")


def parse(files: DataFrame) -> DataFrame:
    """Steps of session files (path, content); files of no known format are skipped, broken ones are in parse_errors()."""
    return parse_detected(detected(files))


def parse_detected(known: DataFrame) -> DataFrame:
    """Steps of detected() files: only the parsers of formats that occur run, each on its own files."""
    spark = known.sparkSession
    found = {r[0] for r in known.select("format").distinct().collect()}  # at most one a format
    out = None
    for name, parser in {**PAIRED, **NAMED}.items():
        if name in found:
            own = known.filter(F.col("format") == name).withColumn("v", F.expr("try_parse_json(content)"))
            parts = parser(own)
            steps = finish(paired(parts) if name in PAIRED else parts, name)
            out = steps if out is None else out.unionByName(steps)  # one format alone stays dealt out by session
    return spark.createDataFrame([], STEP_COLUMNS) if out is None else out


#: Where the tools keep their sessions, below a home folder.
LAYOUTS = {"claude_code": ".claude/projects/*/*.jsonl", "codex": ".codex/sessions/**/rollout-*.jsonl", "gemini": ".gemini/tmp/*/chats/session-*.json"}


def discover(spark: SparkSession, home: str) -> DataFrame:
    """path, format, mtime_secs of the session files in the known places below a home folder, newest first, unknown times last."""
    root = home.rstrip("/")
    out = spark.createDataFrame([], "path string, format string, mtime_secs long")
    for fmt, layout in LAYOUTS.items():
        top, _, name = layout.rpartition("/")
        # dates are up to three folders deep
        folders = [top.replace("**", "/".join(["*"] * k)).rstrip("/") for k in range(4)] if "**" in top else [top]
        for folder in folders:
            try:
                files = spark.read.format("binaryFile").load(f"{root}/{folder}/{name}")
            except AnalysisException:  # no such place
                continue
            found = files.select("path", F.lit(fmt).alias("format"), F.floor(F.unix_millis("modificationTime") / 1000).alias("mtime_secs"))
            out = out.unionByName(found)
    return out.orderBy(F.desc_nulls_last("mtime_secs"), "path")
