"""Session files that are damaged, and the tables beside the steps."""

import time

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import corpus
from loomtrace.operators import sessions as ops
from loomtrace.sources import formats
from tests.test_sessions import FILES

DAMAGED = {
    "cut": FILES["cc"][:-20],
    "noise": FILES["cx"].replace("\n", "\n{oops\n", 1),
    "untyped": FILES["cx"] + '\n{"payload":{}}',
    "silent": FILES["cc"] + '\n{"type":"user","uuid":"z"}',
    "chat": '{"sessionId":"s","messages":{}}',
}


def test_damaged_files_are_errors_and_give_no_steps(spark):
    sound = FILES | {"blank": FILES["cx"].replace("\n", "\n\r\n \t\n") + "\n"}
    files = spark.createDataFrame(list((sound | DAMAGED).items()), "path string, content string")
    errors = formats.parse_errors(files)
    assert {r["path"]: r["error"] for r in errors.collect()} == {
        "cut": "parsing line 4 of session file",
        "noise": "parsing line 2 of session file",
        "untyped": "parsing line 5 of session file",
        "silent": "parsing line 5 of session file",
        "chat": "messages is no list of messages",
    }
    steps = formats.parse(files)
    assert {r[0] for r in steps.select("session_id").distinct().collect()} == {*FILES, "blank"} - {"no", "em"}
    assert {r["path"] for r in formats.detect(files).filter("status = 'skip'").collect()} == {"no", "em"}
    sessions = ops.sessions(steps)
    assert corpus.totals(sessions, errors).first()["parse_errors"] == len(DAMAGED)
    with pytest.raises(RuntimeError, match="5 sessions"):
        corpus.fail_on_errored(sessions, errors.count())


def test_fork_root_indices(spark):
    rows = [("s", i, i in (5, 1)) for i in (7, 5, 1, 0)] + [("t", 0, False)]
    got = ops.fork_root_indices(spark.createDataFrame(rows, "session_id string, step_index int, is_fork_root boolean"))
    assert {r[0]: r[1] for r in got.collect()} == {"s": [1, 5], "t": []}


def test_top_ten(spark):
    rows = spark.range(12).select(F.concat(F.lit("m"), "id").alias("model"), (F.col("id") % 3).alias("session_count"))
    got = [tuple(r) for r in corpus.top_buckets(rows).collect()]
    assert got == sorted((tuple(r) for r in rows.collect()), key=lambda x: (-x[1], x[0]))[:10]


def test_entries_need_fields_of_the_right_kinds(spark):
    user, answer = '{"type":"user","uuid":"u","message":{"role":"user","content":%s}}', '{"type":"assistant","uuid":"u","message":{"role":"assistant","content":%s}}'
    sound = {
        "text": user % '"x"', "items": user % '[{"type":"image","x":1},{"type":"tool_result","tool_use_id":"t","content":[1]}]', "none": answer % "[]", "other": '{"type":"summary"}',
        "use": answer % '[{"type":"tool_use","id":"i","name":"n","input":null}]', "parent": (user % '"x"').replace('"uuid"', '"parentUuid":null,"uuid"'), "rollout": '{"type":"event_msg","payload":5}',
        "tool": '{"messages":[{"content":null},{"role":"tool","tool_call_id":null}]}', "chat": '{"sessionId":"s","messages":[{"type":"user"}]}',
    }
    bad = {
        "number": user % "5", "no id": (user % '"x"').replace('"uuid":"u",', ""), "no role": (user % '"x"').replace('"role":"user",', ""), "untyped item": user % '[{"text":"x"}]', "result": user % '[{"type":"tool_result","tool_use_id":"t"}]',
        "answer": answer % '"x"', "no input": answer % '[{"type":"tool_use","id":"i","name":"n"}]', "id": answer % '[{"type":"tool_use","id":1,"name":"n","input":1}]', "usage": (answer % "[]").replace('"content"', '"usage":{"input_tokens":"9"},"content"'),
        "time": '{"type":"event_msg","timestamp":5}', "type": '{"type":"response_item"}\n{"type":7}', "untyped": '{"sessionId":"s","messages":[{"content":"x"}]}', "calls": '{"messages":[{"role":"user","tool_calls":"x"}]}', "role": '{"messages":[{"role":5}]}',
    }
    rows = formats.detect(spark.createDataFrame(list((sound | bad).items()), "path string, content string")).collect()
    assert {r["path"] for r in rows if r["status"] == "error"} == set(bad)
    assert {r["path"] for r in rows if r["status"] == "ok"} == set(sound)


def test_damaged_calls_are_errors(spark):
    """A call, a count or a span with a field of a wrong kind makes its file an error; missing ones don't."""
    chat, gem, spans = '{"messages":[%s]}', '{"sessionId":"s","messages":[%s]}', '{"resourceSpans":[{"scopeSpans":[{"spans":[%s]}]}]}'
    call, used = '{"role":"assistant","tool_calls":[%s]}', '{"role":"assistant","usage":%s}'
    sound = {
        "call": chat % call % '{"id":"i","function":{"name":"n","arguments":"{}"}},{}', "no calls": chat % '{"role":"user","tool_calls":[]}', "function": chat % call % '{"function":{}}',
        "usage": chat % used % '{"prompt_tokens":5,"completion_tokens":null}', "no usage": chat % used % "null", "large": chat % used % '{"prompt_tokens":18446744073709551615}',
        "gemini": gem % '{"type":"gemini","toolCalls":[{"id":"i","args":5,"result":null},{"timestamp":null}],"usageMetadata":{"promptTokenCount":0}}',
        "span": spans % '{"name":"n","startTimeUnixNano":"1","attributes":[{"key":"k","value":null}]},{}', "no spans": '{"resourceSpans":[{},{"scopeSpans":[]}]}',
        "lenient": '{"finishReason":"stop","toolCalls":[{"toolName":5}],"toolResults":"x"}',
    }
    bad = {
        "id": chat % call % '{"id":5}', "null id": chat % call % '{"id":null}', "arguments": chat % call % '{"function":{"arguments":{}}}', "null function": chat % call % '{"function":null}',
        "no object": chat % call % '"x"', "null call": chat % call % "null", "null calls": chat % '{"role":"user","tool_calls":null}', "null role": chat % '{"role":null}', "a text": chat % '"x"',
        "count": chat % used % '{"prompt_tokens":"5"}', "fraction": chat % used % '{"prompt_tokens":1.5}', "negative": chat % used % '{"cached_tokens":-1}', "usage list": chat % used % "[]",
        "gem name": gem % '{"type":"gemini","toolCalls":[{"name":7}]}', "gem time": gem % '{"type":"gemini","toolCalls":[{"timestamp":7}]}', "gem count": gem % '{"type":"gemini","usageMetadata":{"promptTokenCount":true}}',
        "span time": spans % '{"startTimeUnixNano":5}', "no key": spans % '{"attributes":[{"value":1}]}', "no value": spans % '{"attributes":[{"key":"k"}]}', "scope": '{"resourceSpans":[{"scopeSpans":{}}]}',
    }
    files = spark.createDataFrame(list((sound | bad).items()), "path string, content string")
    rows = formats.detect(files).collect()
    assert {r["path"] for r in rows if r["status"] == "error"} == set(bad)
    assert {r["path"] for r in rows if r["status"] == "ok"} == set(sound)
    steps = formats.parse(files.filter("path in ('lenient', 'id', 'call')")).collect()
    assert {(r.session_id, r.kind, r.tool_name) for r in steps} == {("lenient", "tool_use", "(unknown)"), ("call", "tool_use", "n"), ("call", "tool_use", "")}


def test_checking_a_file_costs_its_length(spark):
    line = '{"type":"user","uuid":"u","message":{"role":"user","content":"%s"}}'
    whole = "\n".join(line % f"turn {i} of a long session" for i in range(8000))
    files = spark.createDataFrame([("long", bytearray(whole, "utf-8")), ("cut", bytearray(whole + "\n{", "utf-8"))], "path string, content binary")
    began = time.time()
    found = {r.path: (r.status, r.error) for r in formats.detect(files).select("path", "status", "error").filter("status <> 'skip'").collect()}
    assert found == {"long": ("ok", None), "cut": ("error", "parsing line 8001 of session file")}
    assert time.time() - began < 30


def test_a_file_is_parsed_once_however_often_its_format_is_asked(spark):
    files = spark.createDataFrame([("a", '{"messages":[]}')], "path string, content string")
    good = formats.detect(files).filter("status = 'ok'").select("path", "content", "format")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") <= 3  # the file, and its lines as either format of lines
    assert [tuple(r) for r in good.collect()] == [("a", '{"messages":[]}', "generic")]


def test_messages_of_chats_are_read_once_and_give_their_steps_in_order(spark):
    call = '{"id":"%s","function":{"name":"Read","arguments":"{}"}}'
    text = '{"messages":[%s]}' % ",".join((
        '{"role":"assistant","content":" ","model":"m","usage":{"prompt_tokens":7},"tool_calls":[%s,%s]}' % (call % "a", call % "b"),  # no text: the first call has the counters
        '{"role":"user","content":"ask","model":"m","tool_calls":[%s]}' % (call % "c"),  # only an assistant's count
        '{"role":"tool","tool_call_id":"b","content":[{"type":"text","text":"x"},{"type":"text","text":"y"}]}', '{"role":"tool","content":null}', '{"content":"nobody"}',
        '{"role":"assistant","content":"said","model":"m","usage":{"prompt_tokens":8},"tool_calls":[{}]}',
    ))
    files = spark.createDataFrame([("p", text)], "path string, content string").withColumn("v", F.expr("try_parse_json(content)"))
    parts = formats.generic(files)
    columns = ("position", "kind", "text", "tool_name", "tool_call_id", "input_text", "result_text", "model", "tokens_in")
    assert sorted(tuple(r[c] for c in columns) for r in parts.collect()) == [
        ([0, 1], "tool_use", None, "Read", "a", "{}", None, "m", 7), ([0, 2], "tool_use", None, "Read", "b", "{}", None, None, None),
        ([1, 0], "user_text", "ask", None, None, None, None, None, None), ([2, 0], "tool_result", None, None, "b", None, "x\ny", None, None),
        ([3, 0], "tool_result", None, None, "", None, "", None, None), ([5, 0], "assistant_text", "said", None, None, None, None, "m", 8),
        ([5, 1], "tool_use", None, "", "", "", None, None, None),
    ]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Exchange" not in plan
