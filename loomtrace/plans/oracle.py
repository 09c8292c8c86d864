"""SQL texts (DuckDB) for the registered queries."""

STEPS = r"""
WITH raw AS (
  SELECT user_id::VARCHAR AS session_id, event_id, event_type, epoch_us(ts) // 1000 AS timestamp_ms, floor(value)::BIGINT AS v, (props->>'$.k')::BIGINT AS k,
    (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS step_index,
    CASE event_type WHEN 'view' THEN 'user_text' WHEN 'signup' THEN 'assistant_text' WHEN 'click' THEN 'tool_use' ELSE 'tool_result' END AS kind FROM events
), typed AS (
  SELECT session_id, event_id, step_index, kind, timestamp_ms, k,
    CASE kind WHEN 'user_text' THEN 'please view item ' || k WHEN 'assistant_text' THEN 'signed up with plan ' || k END AS text,
    CASE WHEN kind = 'tool_use' THEN ['Read', 'Edit', 'Bash', 'Grep', 'Write', 'WebFetch'][k % 6 + 1] END AS own_tool,
    CASE WHEN kind LIKE 'tool%' THEN 'call-number-' || k END AS tool_call_id,
    CASE WHEN kind = 'tool_use' THEN '{"command":"job ' || k || '"}' END AS own_input,
    CASE WHEN kind = 'tool_result' THEN CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'Error: no item ' || k ELSE 'exit code ' || (k % 3) END ELSE 'bought ' || v END END AS result_text,
    CASE WHEN kind = 'assistant_text' THEN ['claude-opus-4-8', 'claude-opus-4-6', 'claude-sonnet-4-6', 'claude-haiku-4-5', 'gpt-5', 'gpt-5-mini', 'gemini-2-5-pro', 'gemini-2-5-flash', 'unpriced-model'][event_id % 9 + 1] END AS model,
    CASE WHEN kind = 'assistant_text' THEN v * 10 END AS tokens_in, CASE WHEN kind = 'assistant_text' THEN v END AS tokens_out,
    CASE WHEN kind = 'assistant_text' THEN event_id % 50 END AS cache_read, CASE WHEN kind = 'assistant_text' AND event_id % 7 > 0 THEN event_id % 7 END AS cache_create
  FROM raw
), calls AS (
  SELECT session_id, tool_call_id, arg_max(own_tool, step_index) AS tool, arg_max(own_input, step_index) AS input FROM typed WHERE kind = 'tool_use' GROUP BY ALL
), named AS (
  SELECT t.*, CASE WHEN kind = 'tool_use' THEN own_tool ELSE c.tool END AS tool_name, CASE WHEN kind = 'tool_use' THEN own_input ELSE c.input END AS input_text
  FROM typed t LEFT JOIN calls c ON t.session_id = c.session_id AND t.tool_call_id = c.tool_call_id AND t.kind = 'tool_result'
), steps AS (
  SELECT session_id, step_index, event_id, 'generic' AS format, kind,
    CASE kind WHEN 'user_text' THEN '[user]   ' || text WHEN 'assistant_text' THEN '[asst]   ' || text
      WHEN 'tool_use' THEN '[tool]   ' || tool_name || ' (' || CASE WHEN length(tool_call_id) > 12 THEN substr(tool_call_id, 1, 11) || '…' ELSE tool_call_id END || ')'
      ELSE '[result] ' || coalesce(tool_name, '(unknown)') || ' → ' || result_text END AS label,
    CASE WHEN kind LIKE '%text' THEN text ELSE 'Tool: ' || coalesce(tool_name, '(unknown)') || chr(10) || 'ID: ' || tool_call_id || chr(10) || chr(10)
      || CASE WHEN kind = 'tool_use' THEN 'Input:' || chr(10) || input_text ELSE coalesce('Input:' || chr(10) || input_text || chr(10) || chr(10), '') || 'Result:' || chr(10) || result_text END END AS detail,
    tool_name, tool_call_id, timestamp_ms, CASE WHEN timestamp_ms >= lag(timestamp_ms) OVER w THEN timestamp_ms - lag(timestamp_ms) OVER w END AS duration_ms,
    model, tokens_in, tokens_out, cache_read, cache_create, false AS is_fork_root, input_text, result_text,
    kind = 'tool_result' AND (contains(result_text, 'Error:') OR regexp_matches(result_text, 'exit code 0*[1-9]')) AS is_error
  FROM named WINDOW w AS (PARTITION BY session_id ORDER BY step_index)
), prices(name, i, o, r, c) AS (
  VALUES ('claude-opus-4-8', 15000, 75000, 1500, 18750), ('claude-opus-4-6', 15000, 75000, 1500, 18750), ('claude-sonnet-4-6', 3000, 15000, 300, 3750), ('claude-haiku-4-5', 1000, 5000, 100, 1250),
    ('gpt-5', 10000, 30000, 2500, 10000), ('gpt-5-mini', 500, 2000, 100, 500), ('gemini-2-5-pro', 2500, 15000, 625, 2500), ('gemini-2-5-flash', 300, 2500, 75, 300)
), costed AS (
  SELECT s.*, CASE WHEN p.name IS NOT NULL AND greatest(coalesce(tokens_in, 0), coalesce(tokens_out, 0), coalesce(cache_read, 0), coalesce(cache_create, 0)) > 0
    THEN coalesce(tokens_in, 0) * i + coalesce(tokens_out, 0) * o + coalesce(cache_read, 0) * r + coalesce(cache_create, 0) * c END AS cost_nano
  FROM steps s LEFT JOIN prices p ON s.model = p.name
), tools AS (
  SELECT session_id, tool_name, count(*) FILTER (kind = 'tool_use') AS use_count, count(*) FILTER (kind = 'tool_result') AS result_count, count(*) FILTER (is_error) AS error_count
  FROM steps WHERE tool_name IS NOT NULL GROUP BY ALL
), models AS (
  SELECT session_id, list(model ORDER BY pos) AS models FROM (SELECT session_id, model, min(step_index) AS pos FROM steps WHERE model IS NOT NULL GROUP BY ALL) GROUP BY session_id
), totals AS (
  SELECT session_id, count(*) AS step_count, coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out, coalesce(sum(cache_read), 0)::BIGINT AS cache_read,
    coalesce(sum(cache_create), 0)::BIGINT AS cache_create, sum(cost_nano) / 1e9 AS cost_usd, max(timestamp_ms) // 1000 AS mtime_secs,
    count(*) FILTER (kind = 'user_text') AS n_user_text, count(*) FILTER (kind = 'assistant_text') AS n_assistant_text, count(*) FILTER (kind = 'tool_use') AS n_tool_use, count(*) FILTER (kind = 'tool_result') AS n_tool_result
  FROM costed GROUP BY session_id
), sess AS (
  SELECT t.*, coalesce(m.models, []) AS models, coalesce(e.error_count, 0)::BIGINT AS error_count, coalesce(e.calls, 0)::BIGINT AS tool_calls, coalesce(e.names, []) AS names
  FROM totals t LEFT JOIN models m USING (session_id) LEFT JOIN (SELECT session_id, sum(error_count) AS error_count, sum(use_count) AS calls, list(tool_name) AS names FROM tools GROUP BY session_id) e USING (session_id)
)
"""

ORACLE_SQL = {
    "event_steps": STEPS + "SELECT * EXCLUDE (event_id, is_error) FROM steps",
    "tool_buckets": STEPS + "SELECT tool_name, sum(use_count)::BIGINT AS use_count, sum(error_count)::BIGINT AS error_count, count(*) AS session_count FROM tools GROUP BY tool_name",
    "tool_stats": STEPS + "SELECT *, CASE WHEN result_count > 0 THEN error_count / result_count END AS error_rate, CASE WHEN use_count > 0 THEN error_count / use_count END AS error_rate_of_uses FROM tools",
    "sessions": STEPS + "SELECT session_id, 'generic' AS format, step_count, tokens_in, tokens_out, cache_read, cache_create, cost_usd, n_user_text, n_assistant_text, n_tool_use, n_tool_result, array_to_string(models, ',') AS models, error_count, tool_calls, mtime_secs FROM sess",
    "step_costs": STEPS + "SELECT session_id, step_index, model, cost_nano / 1e9 AS cost_usd FROM costed WHERE model IS NOT NULL",
    "corpus_totals": STEPS + "SELECT count(*) FILTER (error_count > 0) AS session_count, count(*) FILTER (error_count = 0) AS filtered_out_count, coalesce(sum(step_count) FILTER (error_count > 0), 0)::BIGINT AS step_count, coalesce(sum(tokens_in) FILTER (error_count > 0), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out) FILTER (error_count > 0), 0)::BIGINT AS tokens_out, coalesce(sum(cache_read) FILTER (error_count > 0), 0)::BIGINT AS cache_read, coalesce(sum(cache_create) FILTER (error_count > 0), 0)::BIGINT AS cache_create, round(sum(cost_usd) FILTER (error_count > 0), 6) AS cost_usd, coalesce(sum(error_count) FILTER (error_count > 0), 0)::BIGINT AS error_count FROM sess",
    "model_buckets": STEPS + "SELECT model, count(*) AS session_count, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 6) AS cost_usd FROM (SELECT unnest(models) AS model, * FROM sess) GROUP BY model",
    "format_buckets": STEPS + "SELECT 'generic' AS format, count(*) AS session_count FROM sess",
    "trajectory_stats": STEPS
    + "SELECT count(*) AS sessions, "
    + ", ".join(
        f"min({c})::BIGINT AS {n}_min, quantile_disc({c}, 0.5)::BIGINT AS {n}_p50, quantile_disc({c}, 0.9)::BIGINT AS {n}_p90, quantile_disc({c}, 0.99)::BIGINT AS {n}_p99, max({c})::BIGINT AS {n}_max, sum({c}) / count(*) AS {n}_mean, sum({c})::BIGINT AS {n}_total"
        for n, c in (("steps", "step_count"), ("tool_calls", "tool_calls"), ("tokens_in", "tokens_in"), ("tokens_out", "tokens_out"))
    )
    + ", 0.0::DOUBLE AS branched_rate, 0.0::DOUBLE AS annotated_rate, count(*) FILTER (error_count > 0) / count(*) AS errored_rate FROM sess",
    "sessions_by_model": STEPS + "SELECT session_id FROM sess WHERE list_contains(models, 'gpt-5')",
    "sessions_by_tool": STEPS + "SELECT session_id FROM sess WHERE list_contains(names, 'Bash')",
    "sessions_errored": STEPS + "SELECT session_id, error_count FROM sess WHERE error_count > 0",
    **{
        f"order_by_{m}": STEPS + f"SELECT session_id, row_number() OVER (ORDER BY {o}, session_id)::INT AS place FROM sess"
        for m, o in {"mtime": "mtime_secs DESC", "cost": "coalesce(cost_usd, 0) DESC", "errors": "error_count DESC", "tokens": "tokens_in + tokens_out DESC", "format": "1"}.items()
    },
    "most_recent_sessions": STEPS + "SELECT session_id, mtime_secs FROM sess ORDER BY mtime_secs DESC NULLS LAST, session_id LIMIT 25",
    "top_tools": STEPS + "SELECT session_id, tool_name, use_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY use_count DESC, tool_name)::INT AS rank FROM tools) WHERE rank <= 8",
    "recent_errors": STEPS + "SELECT session_id, step_index, tool_name, substr(detail, 1, 200) AS preview, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step_index DESC)::INT AS rank FROM steps WHERE is_error) WHERE rank <= 5",
    "slice_steps": STEPS + "SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY step_index) - 1)::INT AS step_index, label FROM steps WHERE step_index >= 3 AND step_index < 10",
    "slice_time": STEPS + "SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY step_index) - 1)::INT AS step_index, label FROM (SELECT *, greatest(timestamp_ms - first(timestamp_ms) OVER (PARTITION BY session_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS off FROM steps) WHERE off >= 3600000 AND off < 90000000",
    "first_at": STEPS + "SELECT session_id, min(step_index)::INT AS step_index FROM (SELECT *, min(timestamp_ms) OVER (PARTITION BY session_id) AS a FROM steps) WHERE timestamp_ms >= a + 7200000 GROUP BY session_id",
    "label_filter": STEPS + "SELECT session_id, step_index, label FROM steps WHERE contains(lower(label), 'grep')",
    "search": STEPS + "SELECT session_id, step_index, kind, substr(detail, 1, 120) AS preview, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step_index)::INT AS rank FROM steps WHERE contains(lower(label), 'item 4') OR contains(lower(detail), 'item 4')) WHERE rank <= 20",
    "conversation_view": STEPS + "SELECT session_id, step_index, detail FROM steps WHERE kind LIKE '%text'",
    "tool_density": STEPS + "SELECT session_id, step_index, kind, density, CASE WHEN density = 0 THEN 0 WHEN density <= 2 THEN 1 WHEN density <= 4 THEN 2 WHEN density <= 7 THEN 3 WHEN density <= 10 THEN 4 ELSE 5 END AS bucket FROM (SELECT *, count(*) FILTER (kind LIKE 'tool%') OVER (PARTITION BY session_id ORDER BY step_index ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS density FROM steps)",
    "parallel_batches": STEPS + "SELECT session_id, step_index, kind, kind LIKE 'tool%' AND (coalesce(lag(kind) OVER w = kind, false) OR coalesce(lead(kind) OVER w = kind, false)) AS in_batch FROM steps WINDOW w AS (PARTITION BY session_id ORDER BY step_index)",
    "text_context": STEPS + "SELECT session_id, step_index, kind, max(CASE WHEN kind LIKE '%text' THEN step_index END) OVER (PARTITION BY session_id ORDER BY step_index) AS context_index FROM steps",
    "fork_flags": "SELECT event_id AS entry, user_id::VARCHAR AS session_id, count(*) OVER (PARTITION BY user_id, event_id // 300) > 1 AS is_fork_root FROM events",
    "compare_tools": STEPS
    + "SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.tool_name, b.tool_name) AS tool_name, CASE WHEN a.use_count IS NULL THEN 'b' WHEN b.use_count IS NULL THEN 'a' ELSE 'both' END AS side, coalesce(a.use_count, 0) AS uses_a, coalesce(b.use_count, 0) AS uses_b, coalesce(a.error_count, 0) AS errors_a, coalesce(b.error_count, 0) AS errors_b, coalesce(b.use_count, 0) - coalesce(a.use_count, 0) AS delta FROM (SELECT session_id::BIGINT // 2 AS pair_id, * FROM tools WHERE session_id::BIGINT % 2 = 0) a FULL JOIN (SELECT session_id::BIGINT // 2 AS pair_id, * FROM tools WHERE session_id::BIGINT % 2 = 1) b ON a.pair_id = b.pair_id AND a.tool_name = b.tool_name",
    "nearest_vectors_all": "SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE score >= 0.25) WHERE place <= 30",
    "upsert_notes": "WITH e AS (SELECT user_id::VARCHAR AS session_id, ((props->>'$.k')::BIGINT % 5)::INT AS step_index, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS text, event_id AS pos FROM events), c AS (SELECT * FROM (SELECT *, lag(text) OVER w AS p FROM e WINDOW w AS (PARTITION BY session_id, step_index ORDER BY pos)) WHERE text IS DISTINCT FROM p), l AS (SELECT *, sum((text = '')::INT) OVER (PARTITION BY session_id, step_index ORDER BY pos) AS life, sum((text = '')::INT) OVER (PARTITION BY session_id, step_index) AS last_life FROM c) SELECT session_id, step_index, arg_max(text, pos) AS text, min(pos) AS created_at_ms, max(pos) AS updated_at_ms FROM l WHERE life = last_life AND text <> '' GROUP BY ALL",
    "pii_scan": r"""WITH t AS (SELECT doc_id, text || ' AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 20)) || ' sk-ant-' || md5(doc_id::VARCHAR) || 'abc' AS text FROM documents),
p AS (SELECT doc_id, string_split(text, '@') AS s FROM t),
e AS (SELECT doc_id, unnest(range(1, len(s))) AS i, s FROM p),
m AS (SELECT doc_id, regexp_extract(s[i], '[A-Za-z0-9._+-]+$') AS l, regexp_extract(s[i + 1], '^[A-Za-z0-9.-]+') AS d FROM e)
SELECT doc_id, 'email' AS category, l || '@' || d AS snippet FROM m WHERE l <> '' AND contains(d, '.')
UNION ALL SELECT doc_id, 'aws_access_key', unnest(regexp_extract_all(text, 'AKIA[A-Za-z0-9_-]{16,}')) FROM t
UNION ALL SELECT doc_id, 'anthropic_key', unnest(regexp_extract_all(text, 'sk-ant-[A-Za-z0-9_-]{32,}')) FROM t""",
    "redact": "SELECT doc_id, replace(replace(text, 'the', '[REDACTED]'), 'que', '[REDACTED]') AS text FROM documents",
    "previews": "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(translate(text, chr(10), ' '), 1, 60) || '…' ELSE translate(text, chr(10), ' ') END AS preview FROM documents",
    "trajectory_lines": STEPS + """SELECT session_id, '{"messages":[' || string_agg(CASE kind WHEN 'user_text' THEN '{"role":"user","content":"' || detail || '"}' WHEN 'assistant_text' THEN '{"role":"assistant","content":"' || detail || '"}'
 WHEN 'tool_use' THEN '{"role":"assistant","tool_calls":[{"id":"' || tool_call_id || '","type":"function","function":{"name":"' || tool_name || '","arguments":"' || replace(input_text, '"', '\\"') || '"}}]}'
 ELSE '{"role":"tool","content":"' || result_text || '","tool_call_id":"' || tool_call_id || '"}' END, ',' ORDER BY step_index) || ']}' AS line FROM steps GROUP BY session_id""".replace("\\\\", "\\"),
    "conversation_steps": "SELECT conv_id::VARCHAR AS session_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS step_index, role || '_text' AS kind, text AS detail FROM conversations WHERE role IN ('user', 'assistant')",
    "raw_generic_steps": "SELECT conv_id::VARCHAR AS session_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS step_index, role || '_text' AS kind, text AS detail FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''",
    "shell_commands": STEPS + "SELECT session_id, step_index, 'job ' || substr(tool_call_id, 13) AS command FROM steps WHERE kind = 'tool_use' AND tool_name = 'Bash'",
    "stream_errors": STEPS + "SELECT session_id, event_id AS step_id FROM steps WHERE is_error",
    "stream_totals": "SELECT user_id::VARCHAR AS session_id, event_type AS tool_name, count(*) AS steps FROM events GROUP BY ALL",
}
