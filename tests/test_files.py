"""Session files of all formats, with totals known beforehand, and the tables beside them."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace import api
from loomtrace.operators import corpus, export
from loomtrace.operators import sessions as ops
from loomtrace.sources import drift, formats, notes
from loomtrace.sources.run_trees import listed_runs


def lines(*rows):
    return "\n".join(json.dumps(r) for r in rows)


def parent_linked():
    """One question, four answers, three tools: 740 + 345 tokens, 6,810 read from the cache and 1,500 put there."""
    usage = [(240, 100, 0, 1500), (200, 85, 2270, 0), (200, 80, 2270, 0), (100, 80, 2270, 0)]
    rows = [
        {"type": "summary"},
        {"type": "user", "uuid": "u0", "timestamp": "2025-02-03T10:00:00Z", "message": {"role": "user", "content": "tidy the shelf"}},
    ]
    for k, (i, o, r, c) in enumerate(usage):
        items = [{"type": "text", "text": f"look {k}"}]
        if k < 3:
            items.append({"type": "tool_use", "id": f"t{k}", "name": ("Read", "Grep", "Bash")[k], "input": {"z": k, "a": [k]}})
        counters = {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": r, "cache_creation_input_tokens": c}
        rows.append(
            {
                "type": "assistant",
                "uuid": f"a{k}",
                "parentUuid": f"u{k}",
                "timestamp": f"2025-02-03T10:00:0{k + 1}Z",
                "message": {"role": "assistant", "model": "claude-opus-4-6", "usage": counters, "content": items},
            }
        )
        if k < 3:
            result = [{"type": "text", "text": "found"}] if k == 1 else "Error: none" if k == 2 else "ok"
            rows.append(
                {
                    "type": "user",
                    "uuid": f"u{k + 1}",
                    "parentUuid": f"a{k}",
                    "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"t{k}", "content": result}]},
                }
            )
    return lines(*rows)


def rollout():
    item = lambda **p: {"type": "response_item", "timestamp": "2025-02-03T10:00:00Z", "payload": p}
    rows = [
        {"type": "session_meta", "payload": {}},
        item(type="message", role="developer", content=[{"text": "rules"}]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "count"}]),
    ]
    for k in range(3):
        rows.append(item(type="message", role="assistant", content=[{"text": f"step {k}"}]))
        if k < 2:
            rows += [
                item(type="function_call", call_id=f"c{k}", name="shell", arguments='{"cmd":"wc"}'),
                item(type="reasoning"),
                item(type="function_call_output", call_id=f"c{k}", output="12"),
            ]
    return lines(*rows)


def chat():
    call = lambda k: {"id": f"g{k}", "name": "list", "args": {"dir": "/"}, "result": [{"functionResponse": {"response": {"output": "a b"}}}]}
    answers = [{"type": "gemini", "model": "gemini-unpriced", "content": f"part {k}", "toolCalls": [call(k)] if k < 2 else []} for k in range(3)]
    return json.dumps(
        {"sessionId": "s", "messages": [{"type": "user", "content": [{"text": "where"}]}, *answers, {"type": "info", "content": "skipped"}]}
    )


def conversation():
    rows = [{"role": "system", "content": "be kind"}, {"role": "user", "content": "sum"}]
    for k in range(3):
        calls = [{"id": f"o{k}", "function": {"name": "add", "arguments": "{}"}}] if k < 2 else []
        rows.append({"role": "assistant", "content": f"so {k}", "tool_calls": calls})
        rows += [{"role": "tool", "tool_call_id": c["id"], "content": "4"} for c in calls]
    return json.dumps({"messages": rows})


def tree():
    """A chain whose second model run starts after the tool, though it is listed first."""
    said = lambda data: {
        "generations": [[{"message": {"data": data}}]],
        "llm_output": {"model_name": "gpt-5", "token_usage": {"prompt_tokens": 150, "completion_tokens": 37 + ("tool_calls" in data)}},
    }
    first = {
        "id": "m1",
        "name": "llm",
        "run_type": "chat_model",
        "start_time": "2025-02-03T10:00:01",
        "outputs": said({"content": "let me see", "tool_calls": [{"id": "call", "name": "weather", "args": {"b": 1, "a": 2}}]}),
    }
    tool = {
        "id": "t1",
        "name": "weather",
        "run_type": "tool",
        "start_time": "2025-02-03T10:00:02",
        "inputs": {"input": {"place": "x"}},
        "outputs": {"output": "rain"},
    }
    last = {"id": "m2", "name": "llm", "run_type": "llm", "start_time": "2025-02-03T10:00:03", "outputs": said({"content": "it rains"})}
    chain = {"id": "inner", "run_type": "chain", "child_runs": [last, tool]}
    return json.dumps(
        {
            "id": "root",
            "run_type": "chain",
            "start_time": "2025-02-03T10:00:00",
            "inputs": {"messages": [[{"type": "system"}, {"type": "human", "data": {"content": "umbrella?"}}]]},
            "child_runs": [chain, first],
        }
    )


def multi_step():
    step = lambda kind, text, i, o, **more: {
        "stepType": kind,
        "text": text,
        "usage": {"promptTokens": i, "completionTokens": o},
        "response": {"modelId": "gpt-5", "timestamp": "2025-02-03T10:00:00Z"},
        **more,
    }
    call = {"toolCallId": "v", "toolName": "find", "args": {"q": 1}}
    return json.dumps(
        {
            "finishReason": "stop",
            "messages": [{"role": "user", "content": "find it"}],
            "steps": [
                step("initial", "looking", 100, 25, toolCalls=[call], toolResults=[{**call, "result": {"hits": 2}}]),
                step("tool-result", "two", 200, 50),
            ],
        }
    )


def spans():
    attribute = lambda k, v: {"key": k, "value": {"stringValue" if isinstance(v, str) else "intValue": v}}
    span = lambda at, **a: {"startTimeUnixNano": str(at * 10**9), "attributes": [attribute(k.replace("__", "."), v) for k, v in a.items()]}
    rows = [
        span(3, gen_ai__operation__name="chat", gen_ai__request__model="gpt-5", gen_ai__usage__input_tokens=200, gen_ai__usage__output_tokens=50, gen_ai__completion__0__content="done"),
        span(1, gen_ai__operation__name="chat", gen_ai__request__model="gpt-5", gen_ai__usage__input_tokens=100, gen_ai__usage__output_tokens=25, gen_ai__prompt__0__content=" start ", gen_ai__completion__0__content="working"),
        span(2, gen_ai__operation__name="execute_tool", gen_ai__tool__name="make", gen_ai__tool__call__id="k", gen_ai__tool__call__arguments='{"n":1}', gen_ai__tool__call__result="made"),
        span(0, http__route="/"),
    ]
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": rows}]}]})


FILES = {
    "claude_code": parent_linked(),
    "codex": rollout(),
    "gemini": chat(),
    "generic": conversation(),
    "langchain": tree(),
    "vercel_ai": multi_step(),
    "otel_json": spans(),
}
#: steps of each kind, tokens in and out, read from and put into the cache, cost
TOTALS = {
    "claude_code": (1, 4, 3, 3, 740, 345, 6810, 1500, 0.075315), "codex": (1, 3, 2, 2, 0, 0, 0, 0, None), "gemini": (1, 3, 2, 2, 0, 0, 0, 0, None), "generic": (1, 3, 2, 2, 0, 0, 0, 0, None),
    "langchain": (1, 2, 1, 1, 300, 75, 0, 0, 0.00525), "vercel_ai": (1, 2, 1, 1, 300, 75, 0, 0, 0.00525), "otel_json": (1, 2, 1, 1, 300, 75, 0, 0, 0.00525),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string")


@pytest.fixture(scope="module")
def steps(files):
    return formats.parse(files).cache()


def test_formats_are_found(files):
    assert {r["path"]: r["format"] for r in formats.detect(files).collect()} == {k: k for k in FILES}


def test_totals_of_each_format(steps):
    rows = {r["session_id"]: r for r in ops.sessions(steps).collect()}
    for fmt, want in TOTALS.items():
        r = rows[fmt]
        assert (r["n_user_text"], r["n_assistant_text"], r["n_tool_use"], r["n_tool_result"]) == want[:4], fmt
        assert (r["tokens_in"], r["tokens_out"], r["cache_read"], r["cache_create"]) == want[4:8], fmt
        assert r["cost_usd"] == (pytest.approx(want[8]) if want[8] else None) and r["format"] == fmt
    whole = corpus.totals(ops.sessions(steps)).first()
    assert (whole["step_count"], whole["tokens_in"], whole["tokens_out"], whole["cache_read"], whole["cache_create"]) == (50, 1640, 570, 6810, 1500)
    assert whole["cost_usd"] == pytest.approx(0.091065)


def test_session_rows(steps):
    r = ops.sessions(steps).filter("session_id = 'claude_code'").first()
    assert [(t["name"], t["use_count"], t["result_count"], t["error_count"]) for t in r["tool_stats"]] == [
        ("Bash", 1, 1, 1),
        ("Grep", 1, 1, 0),
        ("Read", 1, 1, 0),
    ]
    assert r["models"] == ["claude-opus-4-6"] and r["error_count"] == 1 and r["annotation_count"] == 0


def test_results_made_of_items_are_shown_whole(steps):
    r = steps.filter("session_id = 'claude_code' and tool_name = 'Grep' and kind = 'tool_result'").first()
    assert r["result_text"] == json.dumps([{"text": "found", "type": "text"}], indent=2)


def test_run_trees(spark, steps):
    rows = steps.filter("session_id = 'langchain'").orderBy("step_index").collect()
    assert [(r["kind"], r["tool_name"]) for r in rows] == [
        ("user_text", None),
        ("assistant_text", None),
        ("tool_use", "weather"),
        ("tool_result", "weather"),
        ("assistant_text", None),
    ]
    assert (rows[0]["detail"], rows[2]["tool_call_id"], rows[3]["tool_call_id"], rows[3]["result_text"]) == ("umbrella?", "call", "t1", "rain")
    assert rows[3]["input_text"] == '{\n  "place": "x"\n}' and [r["duration_ms"] for r in rows] == [None, 1000, 0, 1000, 1000]
    alone = {
        "run_type": "tool",
        "id": "i",
        "name": "",
        "inputs": {"k": 1},
        "outputs": {"output": [1]},
        "child_runs": [
            {"run_type": "llm", "outputs": {"generations": [[{"message": {"data": {"content": ["no text"], "tool_calls": [{"args": None}]}}}]]}},
            {"run_type": "tool", "outputs": "bare", "inputs": {"args": 5}, "name": "(unknown)"},
        ],
    }
    got = (
        formats
        .parse(
            spark.createDataFrame(
                [("a", json.dumps(alone)), ("bad", '{"run_type":"tool","inputs":{},"child_runs":{}}')],
                "path string, content string",
            )
        )
        .orderBy("step_index")
        .collect()
    )
    assert [(r["kind"], r["tool_name"], r["input_text"], r["result_text"]) for r in got] == [
        ("tool_use", "(unknown)", '{\n  "k": 1\n}', None), ("tool_result", "(unknown)", '{\n  "k": 1\n}', "[\n  1\n]"), ("tool_use", "(unknown)", "null", None), ("tool_result", "(unknown)", "5", "bare"),
    ]
    errors = (
        formats
        .parse_errors(spark.createDataFrame([("bad", '{"run_type":"tool","inputs":{},"child_runs":{}}')], "path string, content string"))
        .collect()
    )
    assert [tuple(r) for r in errors] == [("bad", "parsing run tree")]
    assert [r["id"] for r in listed_runs(FILES["langchain"])] == ["root", "inner", "m2", "t1", "m1"] and listed_runs("[]") is None


def test_drift_report(spark):
    content = {
        "c": lines({"type": "user", "message": {"content": [{"type": "image"}, {"type": "text"}]}}, {"type": "progress"}, {"no": 1}) + "\n{\n" + lines({"type": "progress"}, {"type": "assistant", "message": {"content": [{"type": "thinking"}, {"type": "tool_result"}]}}),
        "x": lines({"type": "event_msg"}, {"type": "response_item", "payload": {"type": "reasoning"}}, {"type": "response_item", "payload": {"type": "message"}}, {"type": "odd"}),
        "g": '{"sessionId":"s","messages":[{"type":"user"},{"type":"info"},{"type":"info"},{"type":"info"},{"type":"info"}]}',
        "o": '{"messages":[{"role":"critic"}]}', "v": '{"finishReason":"x","steps":[{"stepType":"initial"},{"stepType":"extra"}]}', "l": '{"run_type":"chain","inputs":{},"child_runs":[{"run_type":"retriever"}]}',
        "t": json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"attributes": []}, {"attributes": [{"key": "gen_ai.operation.name", "value": {"stringValue": "embed"}}]}]}]}]}),
        "clean": FILES["generic"],
    }
    rows = spark.createDataFrame([(k, v.encode()) for k, v in content.items()] + [("b", b"\xff\xfe")], "path string, content binary")
    got = {(r["path"], r["section"], r["tag"]): (r["count"], r["first_positions"]) for r in drift.drift_report(formats.detect(rows)).collect()}
    assert got == {
        ("c", "content_item", "image"): (1, [1]), ("c", "top_level", "progress"): (2, [2, 5]), ("c", "top_level", "<no-type-field>"): (1, [3]), ("c", "top_level", "<malformed-json>"): (1, [4]),
        ("c", "content_item", "thinking"): (1, [6]), ("c", "content_item", "tool_result"): (1, [6]), ("x", "payload", "reasoning"): (1, [2]), ("x", "top_level", "odd"): (1, [4]), ("g", "top_level", "info"): (4, [2, 3, 4]),
        ("o", "top_level", "critic"): (1, [1]), ("v", "top_level", "extra"): (1, [2]), ("l", "top_level", "retriever"): (1, [2]), ("t", "top_level", "embed"): (1, [2]), ("b", "top_level", "<binary-otlp-not-scanned>"): (1, [0]),
    }


def test_notes_beside_files(spark, steps):
    note = lambda text: {"text": text, "created_at_ms": 1, "updated_at_ms": 2}
    rows = [
        ("a", json.dumps({"version": 1, "path": "codex", "notes": {"10": note("x"), "2": note("y\nz"), "first": note("w")}})),
        ("gemini", json.dumps({"notes": {"0": note("own")}})),
        ("c", "{"),
        ("d", '{"notes":{"1":{"text":"no times"}}}'),
    ]
    got = notes.sidecar_notes(spark.createDataFrame(rows, "path string, content string"))
    assert sorted((r["session_id"], r["key"], r["step_index"]) for r in got.collect()) == [
        ("codex", "10", 10),
        ("codex", "2", 2),
        ("codex", "first", None),
        ("gemini", "0", 0),
    ]
    sessions = ops.sessions(steps, got)
    assert {r[0]: r[1] for r in sessions.filter(corpus.matches(annotated=True)).select("session_id", "annotation_count").collect()} == {
        "codex": 3,
        "gemini": 1,
    }
    text = {r[0]: r[1] for r in export.markdown(steps, got).collect()}
    assert "annotations: 1\n" in text["codex"] and "> **note**: y\n> z\n\n```\n" in text["codex"] and "annotations" not in text["generic"]
    page = {r[0]: r[1] for r in export.html(steps, got).collect()}
    assert '<div class="note">y<br>\nz</div>' in page["codex"] and page["codex"].count("<pre>") == 8


def test_transcripts(steps):
    text = {r[0]: r[1] for r in export.markdown(steps).collect()}
    assert text["claude_code"].startswith(
        "# session transcript\n\ntokens — in: 740, out: 345, cache_read: 6810, cache_create: 1500\nmodels: claude-opus-4-6\nestimated cost: $0.0753 USD\n\n## [user] — step 1 (user)\n\n```\ntidy the shelf\n```\n\n"
    )
    assert "**Δ**: 1.0s  ·  **model**: `claude-opus-4-6`  ·  **tokens**: in=240 out=100 cache_read=0 cache_create=1500  ·  **cost**: $0.0392\n\n" in text[
        "claude_code"
    ]
    assert "cost" not in export.markdown(steps, costs=False).filter("session_id = 'claude_code'").first()[1]
    assert text["codex"].startswith("# session transcript\n\n\n## [user] — step 1 (user)")
    page = {r[0]: r[1] for r in export.html(steps).collect()}["claude_code"]
    assert "$0.0753 USD<br>\n</div>" in page and "&quot;a&quot;: [" in page and "<script" not in page


def test_corpus_document(spark, steps, tmp_path):
    errors = spark.createDataFrame([("p", "e")], "path string, error string")
    document = export.corpus_document(ops.sessions(steps), errors, ~corpus.matches(tool="shell"))
    got = json.loads(document.first()[0])
    assert (got["file_count"], got["parse_success_count"], got["parse_error_count"], got["filtered_out_count"], got["total_steps"]) == (
        8,
        6,
        1,
        1,
        42,
    )
    assert got["per_model"][0] == {"model": "gpt-5", "session_count": 3, "tokens_in": 900, "tokens_out": 225, "cost_usd": 0.01575}
    assert [x["tool"] for x in got["per_tool"]][:2] == ["add", "list"] and got["per_format"][0] == {"format": "Claude Code", "session_count": 1}
    export.write_corpus_document(document, f"{tmp_path}/doc")
    assert json.loads(spark.read.text(f"{tmp_path}/doc").first()[0]) == got
    none = json.loads(export.corpus_document(ops.sessions(steps).limit(0)).first()[0])
    assert none["total_cost_usd"] is None and none["per_tool"] == [] and none["total_steps"] == 0


def test_front_doors(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "one.jsonl").write_text(FILES["codex"])
    (tmp_path / "a" / "two.json").write_text(FILES["langchain"])
    (deep / "bad.json").write_text('{"sessionId":"s","messages":{}}')
    (deep / "notes.txt").write_text("nothing")
    for folder in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
        names = lambda depth: sorted(r["path"].rsplit("/", 1)[1] for r in formats.read_files(spark, folder, depth).select("path").collect())  # noqa: B023, E731
        assert names(1) == ["one.jsonl"] and names(2) == ["one.jsonl", "two.json"] and len(names(3)) == 4
    assert api.load_steps(spark, f"{tmp_path}/a/two.json").count() == 5
    rows = api.load_corpus(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["step_count"], r["error"]) for r in rows] == [
        ("two.json", 5, None),
        ("one.jsonl", 8, None),
        ("bad.json", None, "messages is no list of messages"),
    ]
    assert all(r["mtime_secs"] for r in rows[:2])
    assert [tuple(r) for r in api.scan_pii(spark, "mail a@b.co").collect()] == [("email", 0, "a@b.co")]


def test_known_places(spark, tmp_path):
    for at, name in enumerate((".claude/projects/p/x.jsonl", ".codex/sessions/2025/02/03/rollout-1.jsonl", ".codex/sessions/rollout-2.jsonl", ".gemini/tmp/q/chats/session-1.json", ".gemini/tmp/q/chats/other.json", ".claude/projects/p/x.txt")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("{}")
        import os

        os.utime(path, (1000 + at, 1000 + at))
    got = [(r["path"].rsplit("/", 1)[1], r["format"], r["mtime_secs"]) for r in formats.discover(spark, str(tmp_path)).collect()]
    assert got == [
        ("session-1.json", "gemini", 1003),
        ("rollout-2.jsonl", "codex", 1002),
        ("rollout-1.jsonl", "codex", 1001),
        ("x.jsonl", "claude_code", 1000),
    ]
    assert formats.discover(spark, f"{tmp_path}/none").count() == 0


def test_scan_report_names_hits(spark):
    from loomtrace.functions import pii

    rows = [
        ("s", 0, "detail", "email", "a@b.co"),
        ("s", 0, "label", "email", "a@b.co"),
        ("s", 4, "detail", "email", "c" * 50),
        ("t", 1, "detail", "email", "z@z.zz"),
        ("t", 2, "detail", "ipv4", "9" * 50),
    ]
    found = spark.createDataFrame(rows, "session_id string, step_index int, field string, category string, snippet string")
    got = {r["category"]: tuple(r)[1:] for r in pii.scan_report(found).collect()}
    assert got == {"email": (4, "1,1,5", 1, "a@b.co"), "ipv4": (1, "3", 0, "9" * 40 + "…")}


def test_orphans_and_last_calls_pair(spark):
    rows = [
        ("s", 0, "tool_use", "A", "k", "1"),
        ("s", 1, "tool_use", "B", "k", "2"),
        ("s", 2, "tool_result", None, "k", None),
        ("s", 3, "tool_result", None, "none", None),
        ("s", 4, "user_text", None, None, None),
        ("t", 0, "tool_result", None, "k", None),
        ("t", 1, "tool_result", None, None, None),
    ]
    got = ops.paired(
        spark.createDataFrame(rows, "session_id string, position int, kind string, tool_name string, tool_call_id string, input_text string")
    )
    assert {(r["session_id"], r["position"]): (r["tool_name"], r["input_text"]) for r in got.collect()} == {
        ("s", 0): ("A", "1"), ("s", 1): ("B", "2"), ("s", 2): ("B", "2"), ("s", 3): (None, None), ("s", 4): (None, None), ("t", 0): (None, None), ("t", 1): (None, None),
    }


def brute_align(left, right):
    """The whole table."""
    n, m = len(left), len(right)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            t[i + 1][j + 1] = t[i][j] + 1 if left[i] == right[j] else max(t[i][j + 1], t[i + 1][j])
    pairs, i, j = [], n, m
    while i and j:
        if left[i - 1] == right[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    out, i, j = [], 0, 0
    for p, q in [*reversed(pairs), (n, m)]:
        out += [(k, None) for k in range(i, p)] + [(None, k) for k in range(j, q)] + [(p, q)]
        i, j = p + 1, q + 1
    return out[:-1]


def test_alignment_equals_the_whole_table():
    import random

    r = random.Random(2)
    for _ in range(200):
        left, right = ([r.choice("abc") for _ in range(r.randint(0, 30))] for _ in range(2))
        assert corpus.align(left, right) == brute_align(left, right)


def test_buckets_and_shares(steps):
    sessions = ops.sessions(steps)
    got = corpus.trajectory_stats(sessions).first()
    assert (got["sessions"], got["steps_min"], got["steps_p50"], got["steps_max"], got["tokens_in_p99"]) == (7, 5, 8, 11, 740)
    assert got["errored_rate"] == pytest.approx(1 / 7) and got["tool_calls_total"] == 12
    order = [r["session_id"] for r in corpus.placed(sessions, "tokens").orderBy("place").collect()]
    assert order == ["claude_code", "langchain", "otel_json", "vercel_ai", "codex", "gemini", "generic"]
    assert F is not None
