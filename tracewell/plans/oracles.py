"""The registered queries in SQL, over the same tables."""

from __future__ import annotations

_AS_OF_US = (1_704_067_200 + 30 * 86_400) * 1_000_000

# The recipes of the sample inputs.
_EVENTS = """ev AS (
  SELECT *, event_type AS kind, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_id // 10 AS block,
    event_id % 10 AS pos, epoch_us(ts) AS us, (event_id // 10) * 10 + (event_id % 10 - 1) // 2 AS parent
  FROM events),
agent_events AS (
  SELECT event_id AS num, CAST(event_id AS VARCHAR) AS event_id, 'agent-' || user_id AS agent_id,
    'tok-' || (event_id % 2) AS session_token, ts, us, kind, value, k, user_id,
    CASE kind WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'git_commit' ELSE 'tool_call' END AS event_type,
    CASE WHEN kind = 'error' THEN 'error' WHEN value > 200 THEN 'warn' ELSE 'info' END AS severity,
    CASE kind WHEN 'view' THEN 'Read' WHEN 'signup' THEN 'Edit' WHEN 'purchase' THEN 'mcp__git__commit' ELSE 'Bash' END AS tool_name,
    CASE kind WHEN 'purchase' THEN 'mcp' ELSE 'builtin' END AS tool_type,
    CASE kind WHEN 'view' THEN 'Read file via Read' WHEN 'signup' THEN 'Edited file via Edit'
      WHEN 'purchase' THEN 'Git commit via mcp__git__commit' ELSE 'Executed command via Bash' END AS message,
    CASE WHEN kind IN ('view', 'signup') THEN 'src/mod_' || k || '.py' END AS path,
    '/work/p' || (user_id % 4) AS project_dir, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'main' END AS git_branch,
    CAST(floor(value) AS BIGINT) AS duration_ms, md5('t' || block) AS trace_id, substr(md5('s' || event_id), 1, 16) AS span_id,
    CASE WHEN pos > 0 THEN substr(md5('s' || parent), 1, 16) END AS parent_span_id,
    CASE WHEN pos > 0 THEN CAST(parent AS VARCHAR) END AS spawned_by
  FROM ev)"""
_SYSTEM = """so AS (SELECT *, substr(o_orderpriority, 1, 1) AS pri FROM orders),
system_events AS (
  SELECT 'o' || o_orderkey AS event_id, (1704067200 + o_orderkey * 180) * 1000000 AS us,
    CASE WHEN pri = '4' THEN '' WHEN pri <> '5' THEN md5('t' || (o_orderkey // 10)) END AS trace_id,
    substr(md5('o' || o_orderkey), 1, 16) AS span_id,
    CASE WHEN o_orderstatus = 'F' THEN substr(md5('s' || o_orderkey), 1, 16)
      WHEN o_orderstatus = 'O' AND o_orderkey % 10 <> 0 THEN substr(md5('o' || (o_orderkey - 1)), 1, 16)
      WHEN o_orderstatus = 'P' THEN substr(md5('ghost' || o_orderkey), 1, 16) END AS parent_span_id,
    CASE WHEN o_custkey % 5 = 4 THEN 'unknown' ELSE 'svc-' || (o_custkey % 5) END AS source_service,
    CASE WHEN pri = '1' THEN 'error' ELSE 'info' END AS severity, 'HTTP ' || o_orderpriority AS event_name,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS duration_ms
  FROM so)"""
_MEMORY = """mlog AS (
  SELECT vec_id AS seq, 'agent-' || label AS agent_id, 'k' || (vec_id % 40) AS key, 'v' || vec_id AS value, vec_id % 4 AS tag,
    vec_id % 3 = 0 AS shared, vec_id % 17 = 0 AS gone, (1704067200 + vec_id * 60) * 1000000 AS us, embedding
  FROM embeddings),
marks AS (SELECT agent_id, key, max(seq) AS last_seq, max(CASE WHEN gone THEN seq END) AS deleted FROM mlog GROUP BY ALL),
memory AS (
  SELECT l.agent_id, l.key, l.value, l.tag, l.shared, l.us AS updated_at_us, l.embedding,
    (SELECT min(f.us) FROM mlog f WHERE f.agent_id = l.agent_id AND f.key = l.key AND f.seq > coalesce(m.deleted, -1)) AS created_at_us
  FROM mlog l JOIN marks m ON l.agent_id = m.agent_id AND l.key = m.key AND l.seq = m.last_seq WHERE NOT l.gone)"""


def _sessions(timeout_us: int, closes: bool = False) -> str:
    """Events with their session, and one row per session."""
    closed = "pt = 'git_commit'" if closes else "FALSE"
    done = "last_type = 'git_commit'" if closes else "FALSE"
    return f"""{_EVENTS},
prev AS (SELECT *, lag(us) OVER o AS pus, lag(event_type) OVER o AS pt FROM agent_events
  WINDOW o AS (PARTITION BY agent_id, session_token ORDER BY us, num)),
numbered AS (SELECT *, CAST(sum(CASE WHEN pus IS NULL OR us - pus > {timeout_us} OR {closed} THEN 1 ELSE 0 END)
  OVER (PARTITION BY agent_id, session_token ORDER BY us, num) AS BIGINT) AS session_seq FROM prev),
begun AS (SELECT *, min(us) OVER (PARTITION BY agent_id, session_token, session_seq) AS session_started_at_us FROM numbered),
se AS (SELECT *, sha256(agent_id || '|' || session_token || '|' || session_started_at_us) AS session_id FROM begun),
rolled AS (SELECT session_id, session_token, agent_id, session_seq, arg_min(project_dir, us) AS project_dir,
  arg_min(git_branch, us) AS git_branch, min(us) AS started_at_us, max(us) AS last_event_at_us, count(*) AS event_count,
  arg_max(event_type, us) AS last_type, arg_min(event_type, us) AS first_type FROM se GROUP BY ALL),
sessions AS (SELECT *, CASE WHEN {done} THEN 'completed' WHEN last_event_at_us + {timeout_us} < {_AS_OF_US} THEN 'timed_out'
  ELSE 'active' END AS status, CASE WHEN {done} THEN last_event_at_us
  WHEN last_event_at_us + {timeout_us} < {_AS_OF_US} THEN last_event_at_us + {timeout_us} END AS ended_at_us FROM rolled)"""


_30M, _12H = 1_800_000_000, 43_200_000_000
_SESSION_COLUMNS = ("session_id, session_token, agent_id, session_seq, status, project_dir, git_branch, started_at_us, "
                    "ended_at_us, last_event_at_us, event_count")
_S12 = "WITH " + _sessions(_12H)
_MODIFIES = "tool_name = 'Edit' AND path IS NOT NULL"

_SPANS = f"""WITH {_EVENTS},
bad AS (SELECT event_id // 50 AS payload_id, max(value) AS slowest FROM ev GROUP BY ALL),
placed AS (SELECT ev.*, b.payload_id, user_id % 5 AS svc,
    dense_rank() OVER (PARTITION BY b.payload_id ORDER BY user_id % 5) - 1 AS ri,
    row_number() OVER (PARTITION BY b.payload_id, user_id % 5 ORDER BY event_id) - 1 AS pi
  FROM ev JOIN bad b ON ev.event_id // 50 = b.payload_id WHERE b.slowest <= 320),
spans AS (SELECT sha256('trace:' || payload_id || ':' || ri || ':0:' || pi) AS event_id, us AS ts_us, md5('t' || block) AS trace_id,
    substr(md5('s' || event_id), 1, 16) AS span_id, CASE WHEN pos > 0 THEN substr(md5('s' || parent), 1, 16) END AS parent_span_id,
    'otlp' AS source_type, 'trace' AS signal, CASE WHEN svc = 4 THEN 'unknown' ELSE 'svc-' || svc END AS source_service,
    CASE WHEN kind = 'error' THEN 'error' ELSE 'info' END AS severity, 'op ' || kind AS event_name, CAST(NULL AS VARCHAR) AS message,
    '{{"a.kind":"' || kind || '","b.k":' || k || ',"c.even":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"d.ratio":' || k
      || '.5' || CASE WHEN kind = 'click' THEN ',"e.list":["x",{{"n":' || k || '}}]' ELSE '' END || '}}' AS attributes,
    CASE WHEN svc = 4 THEN '{{}}' ELSE '{{"service.name":"svc-' || svc || '"}}' END AS resource,
    CASE WHEN kind <> 'signup' AND floor(value * 1000000) > 0 THEN CAST(floor(value * 1000000) AS BIGINT) // 1000000 END AS duration_ms
  FROM placed)"""
_LOGS = f"""WITH so AS (SELECT *, substr(o_orderpriority, 1, 1) AS pri, CAST(floor(o_totalprice) AS BIGINT) AS whole,
    o_orderkey // 40 AS payload_id, o_custkey % 5 AS svc FROM orders),
bad AS (SELECT payload_id AS bad_id, max(o_totalprice) AS dearest FROM so GROUP BY ALL),
placed AS (SELECT so.*, whole % 25 AS sev, dense_rank() OVER (PARTITION BY payload_id ORDER BY svc) - 1 AS ri,
    row_number() OVER (PARTITION BY payload_id, svc ORDER BY o_orderkey) - 1 AS pi
  FROM so JOIN bad ON payload_id = bad_id WHERE dearest <= 499400)
SELECT sha256('log:' || payload_id || ':' || ri || ':0:' || pi) AS event_id,
  CASE WHEN o_orderstatus = 'P' THEN {_AS_OF_US} + payload_id * 1000000 ELSE (1704067200 + o_orderkey * 180) * 1000000 END AS ts_us,
  CASE WHEN pri <> '5' THEN md5('t' || (o_orderkey // 10)) END AS trace_id, substr(md5('o' || o_orderkey), 1, 16) AS span_id,
  CAST(NULL AS VARCHAR) AS parent_span_id, 'otlp' AS source_type, 'log' AS signal,
  CASE WHEN svc = 4 THEN 'unknown' ELSE 'svc-' || svc END AS source_service,
  CASE WHEN sev >= 17 THEN 'fatal' WHEN sev >= 13 THEN 'error' WHEN sev >= 9 THEN 'warn' WHEN sev >= 5 THEN 'info'
    WHEN sev >= 1 THEN 'debug' ELSE 'info' END AS severity, CAST(NULL AS VARCHAR) AS event_name,
  CASE pri WHEN '1' THEN 'order ' || o_orderkey WHEN '2' THEN CAST(whole AS VARCHAR) WHEN '3' THEN whole || '.5'
    WHEN '4' THEN 'true' END AS message,
  '{{"status":"' || o_orderstatus || '"}}' AS attributes,
  CASE WHEN svc = 4 THEN '{{}}' ELSE '{{"service.name":"svc-' || svc || '"}}' END AS resource, CAST(NULL AS BIGINT) AS duration_ms
FROM placed"""
_SPAN_COLUMNS = ("trace_id, span_id, parent_span_id, source_type, signal, source_service, severity, event_name, message, "
                 "attributes, resource, duration_ms, ts_us")
_WORDS = r"""WITH tokens AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents),
idx AS (SELECT word, doc_id, count(*) AS hits FROM tokens WHERE word <> '' GROUP BY ALL)"""
_TEXT_HITS = _WORDS + """
SELECT doc_id, CAST(sum(hits) AS BIGINT) AS hits FROM idx WHERE word IN ('the', 'and') GROUP BY doc_id HAVING count(*) = 2"""
_SPOTS = r"""WITH cut AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents),
spots AS (SELECT doc_id, len(words) AS length, unnest(words) AS word, generate_subscripts(words, 1) AS position FROM cut)"""
_EMBED = """SELECT doc_id, CAST(length(text) AS BIGINT) AS v0, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS v1,
  CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS v2 FROM documents"""
_ITEMS = f"""{_S12},
raw AS (
  SELECT session_id, 'tool' AS kind, min(us) AS ts_us, tool_name AS item, tool_name AS label, count(*) AS n FROM se GROUP BY ALL
  UNION ALL
  SELECT session_id, 'file', min(us), path, path, count(*) FROM se WHERE {_MODIFIES} GROUP BY session_id, path
  UNION ALL SELECT session_id, 'commit', us, event_id, message, 1 FROM se WHERE event_type = 'git_commit'
  UNION ALL SELECT session_id, 'error', us, event_id, message, 1 FROM se WHERE severity = 'error'
  UNION ALL SELECT session_id, 'moment', us, event_id, message, 1 FROM se
    WHERE event_type = 'git_commit' OR severity = 'error' OR {_MODIFIES}),
items AS (SELECT session_id, kind, row_number() OVER (PARTITION BY session_id, kind ORDER BY ts_us, item) AS pos, ts_us, item, label,
    CAST(n AS BIGINT) AS n FROM raw)"""
_BLAME = f"SELECT path, agent_id, session_id, event_id, us AS ts_us, num FROM se WHERE {_MODIFIES}"
_CORRELATE = f"""{_S12}, {_SYSTEM},
owners AS (SELECT trace_id, arg_min(session_id, us) AS session_id FROM se GROUP BY trace_id)
SELECT s.event_id, s.trace_id, o.session_id FROM system_events s LEFT JOIN owners o ON s.trace_id = o.trace_id AND s.trace_id <> ''"""
_SUMMARY = f"""SELECT session_id, agent_id, CAST(floor((max(us) - min(us)) / 1000000) AS BIGINT) AS duration_seconds, count(*) AS event_count,
  count(DISTINCT CASE WHEN {_MODIFIES} THEN path END) AS files_modified, count(DISTINCT tool_name) AS tools_used,
  count(*) FILTER (event_type = 'git_commit') AS commits, count(*) FILTER (severity = 'error') AS errors FROM se GROUP BY ALL"""
_NEXT = """nx AS (SELECT *, lead(event_id) OVER n AS to_id, lead(tool_name) OVER n AS to_tool FROM se
  WINDOW n AS (PARTITION BY session_id ORDER BY us, num))"""
_CLOSED = f"last_event_at_us + {_12H} <= (SELECT max(us) FROM agent_events) - 600000000"
_AGENTS = "min(started_at_us) AS first_seen_us, max(last_event_at_us) AS last_seen_us"
_VECTORS = """SELECT q.vec_id AS query_id, {id}, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS sim"""

ORACLES = {
    "otlp_traces": f"{_SPANS} SELECT event_id, {_SPAN_COLUMNS} FROM spans",
    "otlp_service_stats": f"""{_SPANS} SELECT source_service, severity, count(*) AS spans, round(avg(duration_ms), 6) AS avg_ms
        FROM spans GROUP BY ALL""",
    "otlp_logs": _LOGS,
    "otlp_rejects": """WITH t AS (SELECT event_id // 50 AS payload_id, max(value) AS m FROM events GROUP BY 1),
        l AS (SELECT o_orderkey // 40 AS payload_id, max(o_totalprice) AS m FROM orders GROUP BY 1)
        SELECT 'trace' AS signal, payload_id, CASE WHEN m > 340 THEN 'malformed' ELSE 'wrong_type' END AS reason FROM t WHERE m > 320
        UNION ALL SELECT 'log', l.payload_id, CASE WHEN m > 499700 THEN 'malformed' ELSE 'wrong_type' END FROM l
        WHERE m > 499700 OR (m > 499400 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey // 40 = l.payload_id
            AND substr(o.o_orderpriority, 1, 1) = '2'))""",
    "hook_events": f"""WITH {_EVENTS} SELECT sha256('hook:' || event_id) AS event_id,
        CASE WHEN agent_id LIKE '%7' THEN 'claude-code-build1' ELSE agent_id END AS agent_id, session_token,
        us // 1000000 * 1000000 AS ts_us, CASE WHEN kind = 'purchase' THEN 'git_commit' ELSE 'tool_call' END AS event_type,
        'info' AS severity, tool_name, tool_type, message,
        '{{' || CASE WHEN path IS NULL THEN '' ELSE '"file_path":"' || path || '",' END
          || '"items":[{{"api_key":"[REDACTED]","n":1}}],"max_tokens":"[REDACTED]","nested":{{"n":' || k
          || ',"password":"[REDACTED]"}}}}' AS params,
        '{{"auth_header":"[REDACTED]","ok":true}}' AS result,
        '{{"git_branch":"","project_dir":"' || project_dir || '"}}' AS context, duration_ms
        FROM agent_events WHERE value >= 0.5 AND value <= 150""",
    "hook_rejects": """SELECT event_id AS payload_id, CASE WHEN value > 200 THEN 'malformed' WHEN value < 0.5 THEN 'wrong_type'
        ELSE 'no_tool_name' END AS reason FROM events WHERE value < 0.5 OR value > 150""",
    "event_batches": f"""WITH {_EVENTS}, b AS (SELECT *, CASE WHEN kind = 'error' THEN num * 2 ELSE num // 20 * 2 + 1 END AS payload_id
          FROM agent_events)
        SELECT sha256('event:' || payload_id || ':' || (row_number() OVER (PARTITION BY payload_id ORDER BY num) - 1)) AS event_id,
        agent_id, session_token, us AS ts_us, event_type, severity, tool_name, message, duration_ms,
        event_type || ',k' || (k % 5) AS tags, trace_id, span_id FROM b""",
    "append_by_day": f"""WITH {_SYSTEM} SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS day, count(*) AS events,
        (SELECT count(*) FROM orders) AS written FROM system_events GROUP BY 1""",
    "redact_params": f"""WITH {_EVENTS} SELECT event_id,
        '{{' || CASE WHEN path IS NULL THEN '' ELSE '"file_path":"' || path || '",' END
          || '"items":[{{"api_key":"[REDACTED]","n":1}}],"max_tokens":"[REDACTED]","nested":{{"n":' || k
          || ',"password":"[REDACTED]"}}}}' AS params, '{{"auth_header":"[REDACTED]","ok":true}}' AS result FROM agent_events""",
    "severity_map": """WITH n AS (SELECT CAST(floor(value / 10) AS BIGINT) - 1 AS severity_number, count(*) AS n FROM events GROUP BY 1)
        SELECT severity_number, CASE WHEN severity_number >= 17 THEN 'fatal' WHEN severity_number >= 13 THEN 'error'
        WHEN severity_number >= 9 THEN 'warn' WHEN severity_number >= 5 THEN 'info' WHEN severity_number >= 1 THEN 'debug'
        ELSE 'info' END AS severity, n FROM n""",
    "agent_id_valid": """SELECT c_custkey, regexp_full_match(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_name
        ELSE replace(c_name, '#', '-') END, '[A-Za-z0-9_-]{1,128}') AS valid FROM customer""",
    "mask_urls": "SELECT page_id, replace(url, '://', '://user:***@') AS url, CASE WHEN html = '' THEN '' ELSE '***' END AS html FROM pages",
    "sessionize_30m": f"WITH {_sessions(_30M)} SELECT event_id, session_id, session_seq, session_started_at_us FROM se",
    "sessionize_12h": f"{_S12} SELECT event_id, session_id, session_seq, session_started_at_us FROM se",
    "sessionize_closes": f"WITH {_sessions(_12H, True)} SELECT event_id, session_id, session_seq, session_started_at_us FROM se",
    "session_rollup_12h": f"{_S12} SELECT {_SESSION_COLUMNS} FROM sessions",
    "session_rollup_closes": f"WITH {_sessions(_12H, True)} SELECT {_SESSION_COLUMNS} FROM sessions",
    "session_attach": f"{_S12} SELECT event_id, session_id FROM se",
    "session_ordinals": f"""{_S12} SELECT session_id, agent_id,
        row_number() OVER (PARTITION BY agent_id ORDER BY started_at_us, session_id) AS ordinal FROM sessions""",
    "idle_session_list": f"""{_S12} SELECT session_id, last_event_at_us FROM sessions
        WHERE status = 'active' AND last_event_at_us < {_AS_OF_US} - {_30M}""",
    "session_list_pinned": f"""{_S12} SELECT session_id, status, first_type = 'git_commit' AS pinned FROM sessions
        WHERE (status = 'active' AND project_dir = '/work/p1') OR first_type = 'git_commit'""",
    "agent_rollup_all": f"""{_S12} SELECT agent_id, {_AGENTS}, count(*) AS total_sessions, CAST(sum(event_count) AS BIGINT) AS total_events,
        CASE WHEN {_AS_OF_US} - max(last_event_at_us) > {_12H} THEN 'offline'
          WHEN {_AS_OF_US} - max(last_event_at_us) > 7200000000 THEN 'idle' ELSE 'active' END AS status
        FROM sessions GROUP BY agent_id""",
    "agents_new": f"""WITH {_EVENTS} SELECT agent_id, min(us) AS first_seen_us, max(us) AS last_seen_us, count(*) AS total_events
        FROM agent_events WHERE agent_id NOT IN (SELECT 'agent-' || c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
        GROUP BY agent_id""",
    "agents_merged": f"""{_S12} SELECT agent_id, {_AGENTS}, count(*) AS total_sessions,
        CAST(sum(event_count) AS BIGINT) AS total_events FROM sessions GROUP BY agent_id""",
    "project_activity": f"""{_S12} SELECT agent_id, project_dir, count(*) AS events, count(DISTINCT session_id) AS sessions,
        count(*) FILTER (severity = 'error') AS errors FROM se GROUP BY ALL""",
    "session_summaries": f"{_S12} {_SUMMARY}",
    "session_summary_items": f"{_ITEMS} SELECT * FROM items",
    "session_summary_lists": f"""{_ITEMS} SELECT session_id, kind, (pos - 1) // 4 AS part,
        '[' || string_agg('{{"pos":' || pos || ',"us":' || ts_us || ',"item":"' || item || '","label":"' || label || '","n":' || n || '}}',
          ',' ORDER BY pos) || ']' AS items FROM items GROUP BY ALL""",
    "session_details": f"""{_S12}, sums AS ({_SUMMARY}) SELECT s.session_id, s.status, s.event_count, m.duration_seconds,
        m.files_modified, m.commits, m.errors FROM sessions s LEFT JOIN sums m
        ON s.session_id = m.session_id AND s.session_token = 'tok-0'""",
    "session_tool_counts": f"{_S12} SELECT session_id, tool_name, count(*) AS calls FROM se GROUP BY ALL",
    "session_file_touches": f"""{_S12} SELECT session_id, path, count(*) AS touches, min(us) AS first_touch_us, max(us) AS last_touch_us
        FROM se WHERE path IS NOT NULL GROUP BY ALL""",
    "session_timeline": f"""{_S12} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY us, num) AS seq, event_id FROM se""",
    "chat_timeline": """SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq,
        'c-' || conv_id || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS event_id, CAST(length(text) AS BIGINT) AS chars FROM conversations""",
    "log_search": f"""WITH {_EVENTS} SELECT event_id, agent_id, us AS ts_us, severity, message FROM agent_events
        WHERE event_type IN ('error', 'tool_call') AND severity IN ('error', 'warn') AND tool_name = 'Bash' AND k % 5 = 3
        AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND message ILIKE '%command%'""",
    "log_search_newest": f"""WITH {_EVENTS} SELECT event_id, us AS ts_us FROM agent_events WHERE severity = 'error'
        AND (ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id > '')) ORDER BY us DESC, event_id LIMIT 50""",
    "chat_search": """SELECT 'c-' || conv_id || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS event_id, CAST(conv_id AS VARCHAR) AS session_id,
        (1704067200 + conv_id * 3600 + turn * 60) * 1000000 AS ts_us FROM conversations
        WHERE role = 'user' AND contains(lower(text), 'the')""",
    "system_list": f"""WITH {_SYSTEM} SELECT event_id, us AS ts_us, source_service, event_name, duration_ms FROM system_events
        WHERE source_service IN ('svc-1', 'unknown') AND severity = 'error' AND event_name ILIKE '%urgent%'""",
    "text_search_scan": _TEXT_HITS,
    "text_search_index": _TEXT_HITS,
    "text_search_ranked": _SPOTS + """, total AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS mean FROM cut),
        hits AS (SELECT doc_id, word, length, count(*) AS tf FROM spots WHERE word IN ('the', 'and', 'of') GROUP BY ALL),
        held AS (SELECT word, ln(1 + (any_value(total.n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM hits, total GROUP BY word),
        scored AS (SELECT doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 9) AS score
          FROM hits JOIN held USING (word), total GROUP BY doc_id)
        SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 100)""",
    "text_search_phrase": _SPOTS + """ SELECT a.doc_id, count(*) AS hits FROM spots a JOIN spots b
        ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.word = 'of' AND b.word = 'the' GROUP BY a.doc_id""",
    "text_index": _WORDS + " SELECT word, doc_id, hits FROM idx",
    "errors_context": f"""{_S12}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, num) AS n FROM se)
        SELECT e.session_id, e.event_id AS error_id, c.n - e.n AS position, c.event_id FROM n e JOIN n c
        ON e.session_id = c.session_id AND c.n BETWEEN e.n - 2 AND e.n + 2 WHERE e.severity = 'error'""",
    "file_blame_last": f"""{_S12}, b AS ({_BLAME}) SELECT path, agent_id, session_id, event_id, ts_us FROM b
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts_us DESC, num DESC) = 1""",
    "file_blame_history": f"""{_S12}, b AS ({_BLAME}) SELECT path,
        row_number() OVER (PARTITION BY path ORDER BY ts_us DESC, num DESC) AS recency, agent_id, event_id FROM b""",
    "trace_correlate": _CORRELATE,
    "trace_layers": f"""WITH {_EVENTS}, {_SYSTEM} SELECT 'agent' AS layer, event_id, us AS ts_us, trace_id, span_id, parent_span_id,
        severity, tool_name AS name, message, duration_ms FROM agent_events UNION ALL
        SELECT 'system', event_id, us, trace_id, span_id, parent_span_id, severity, event_name, NULL, duration_ms FROM system_events""",
    "trace_waterfall": f"""WITH RECURSIVE {_EVENTS}, {_SYSTEM}, x AS (
          SELECT 'agent' AS layer, event_id, us, trace_id, span_id, parent_span_id, duration_ms FROM agent_events UNION ALL
          SELECT 'system', event_id, us, trace_id, span_id, parent_span_id, duration_ms FROM system_events WHERE trace_id <> ''),
        tree AS (SELECT event_id, trace_id, span_id, 0 AS depth FROM x r WHERE NOT EXISTS (SELECT 1 FROM x p
              WHERE p.trace_id = r.trace_id AND p.span_id = r.parent_span_id)
          UNION ALL SELECT c.event_id, c.trace_id, c.span_id, t.depth + 1 FROM tree t JOIN x c
              ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id)
        SELECT x.layer, x.event_id, x.trace_id, t.depth, x.us - min(x.us) OVER (PARTITION BY x.trace_id) AS offset_us, x.duration_ms
        FROM x LEFT JOIN tree t ON x.event_id = t.event_id AND x.trace_id = t.trace_id""",
    "spawn_edge_list": f"""WITH {_EVENTS} SELECT p.event_id AS parent_id, c.event_id AS child_id, p.agent_id AS parent_agent,
        c.agent_id AS child_agent FROM agent_events c JOIN agent_events p ON c.spawned_by = p.event_id""",
    "edges_followed_by": f"{_S12}, {_NEXT} SELECT session_id, event_id AS from_id, to_id FROM nx WHERE to_id IS NOT NULL",
    "edges_tool_patterns": f"""{_S12}, {_NEXT} SELECT tool_name AS from_tool, to_tool, count(*) AS times FROM nx
        WHERE to_id IS NOT NULL GROUP BY ALL""",
    "edges_touched": f"WITH {_EVENTS} SELECT event_id, path FROM agent_events WHERE path IS NOT NULL",
    "edges_caused_by": f"""WITH {_EVENTS} SELECT p.event_id AS parent_id, c.event_id AS child_id FROM agent_events c
        JOIN agent_events p ON c.spawned_by = p.event_id UNION SELECT p.event_id, c.event_id FROM agent_events c JOIN agent_events p
        ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id""",
    "edges_owns": f"{_S12} SELECT agent_id, session_id FROM sessions",
    "edges_spawned_sessions": f"""{_S12} SELECT DISTINCT p.session_id AS parent_session, c.session_id AS child_session FROM se c
        JOIN se p ON c.spawned_by = p.event_id WHERE p.session_id <> c.session_id""",
    "calls_enriched": f"""WITH {_EVENTS} SELECT event_id, CASE WHEN tool_type = 'mcp' THEN 'git' END AS mcp_server, FALSE AS is_subagent,
        severity FROM agent_events""",
    "memory_entries": f"WITH {_MEMORY} SELECT agent_id, key, value, shared, created_at_us, updated_at_us FROM memory",
    "memory_visible": f"WITH {_MEMORY} SELECT agent_id, key, value, shared FROM memory WHERE agent_id = 'agent-1' OR shared",
    "memory_list_tagged": f"""WITH {_MEMORY} SELECT agent_id, key, value, updated_at_us FROM memory
        WHERE (agent_id = 'agent-2' OR shared) AND tag = 1 ORDER BY updated_at_us DESC, key LIMIT 20""",
    "memory_search_top": f"""WITH {_MEMORY}, scored AS ({_VECTORS.format(id="c.agent_id, c.key, c.value, c.agent_id || '|' || c.key AS id")}
          FROM embeddings q, memory c WHERE c.agent_id = 'agent-1' OR c.shared),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM scored)
        SELECT query_id, rank, sim AS similarity, agent_id, key, value FROM best WHERE rank <= 5""",
    "memory_recall": f"""WITH scored AS ({_VECTORS.format(id="c.vec_id AS id")} FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, CAST(id AS VARCHAR)) AS rank FROM scored)
        SELECT query_id, rank, id, sim AS similarity FROM best WHERE rank <= 3""",
    "cosine_self": """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS similarity,
        CAST(NULL AS DOUBLE) AS with_zero FROM embeddings""",
    "vector_dims": "SELECT vec_id, label <> 0 AS ok FROM embeddings",
    "noop_embed": "SELECT doc_id, 384 AS dims, CAST(0 AS DOUBLE) AS total FROM documents",
    "embed_texts": _EMBED,
    "embed_texts_once": _EMBED,
    "retention_10d": f"WITH {_EVENTS} SELECT event_id, us AS ts_us FROM agent_events WHERE us >= {_AS_OF_US} - 864000000000",
    "stream_otlp_traces": f"{_SPANS} SELECT {_SPAN_COLUMNS} FROM spans",
    "stream_otlp_logs": f"""SELECT * EXCLUDE (event_id) REPLACE (
        CASE WHEN json_extract_string(attributes, '$.status') <> 'P' THEN ts_us END AS ts_us) FROM ({_LOGS})""",
    "stream_otlp_rejects_by_reason": """WITH t AS (SELECT max(value) AS m FROM events GROUP BY event_id // 50)
        SELECT CASE WHEN m > 340 THEN 'malformed' ELSE 'wrong_type' END AS reason, count(*) AS payloads FROM t WHERE m > 320 GROUP BY 1""",
    "stream_closed_sessions": f"""{_S12} SELECT session_id, agent_id, session_token, started_at_us, last_event_at_us,
        last_event_at_us + {_12H} AS ended_at_us, event_count FROM sessions WHERE {_CLOSED}""",
    "stream_close_summaries": f"{_S12}, sums AS ({_SUMMARY}) SELECT sums.* FROM sums JOIN sessions USING (session_id) WHERE {_CLOSED}",
    "stream_trace_correlate": _CORRELATE,
    "stream_agent_totals": f"""WITH {_EVENTS} SELECT agent_id, min(us) AS first_seen_us, max(us) AS last_seen_us, count(*) AS total_events
        FROM agent_events GROUP BY agent_id""",
    "stream_embed_texts": _EMBED,
    "errors_context_incomplete": f"""WITH {_sessions(_12H).replace("FROM agent_events" + chr(10) + "  WINDOW", "FROM (SELECT * FROM agent_events WHERE k % 10 <> 7) WINDOW")},
        al AS (SELECT session_id, event_id, severity, us, num FROM se
          UNION ALL SELECT NULL, event_id, severity, us, num FROM agent_events WHERE k % 10 = 7),
        n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, num) AS n FROM al)
        SELECT e.session_id, e.event_id AS error_id, c.n - e.n AS position, c.event_id FROM n e JOIN n c
        ON e.session_id IS NOT DISTINCT FROM c.session_id AND c.n BETWEEN e.n - 2 AND e.n + 2 WHERE e.severity = 'error'""",
    "log_search_untimed": f"""WITH {_EVENTS}, errors AS (
          SELECT event_id, CASE WHEN k % 10 <> 3 THEN us END AS ts_us FROM agent_events WHERE severity = 'error'),
        one AS (SELECT 1 AS page, * FROM errors WHERE ts_us IS NULL OR ts_us <= 1704067200000000
          ORDER BY ts_us DESC NULLS LAST, event_id LIMIT 40),
        two AS (SELECT 2 AS page, * FROM errors WHERE ts_us IS NULL AND event_id > '5' ORDER BY event_id LIMIT 40)
        SELECT * FROM one UNION ALL SELECT * FROM two""",
    "append_once_counts": f"""WITH {_EVENTS}, cut AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS late FROM agent_events)
        SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS day, count(*) AS events,
          (SELECT count(*) FROM cut WHERE late OR num % 3 = 0) AS seen, (SELECT count(*) FROM cut WHERE late) AS inserted
        FROM cut GROUP BY 1""",
    "stream_closed_sessions_closes": f"""WITH {_sessions(_12H, True)},
        mark AS (SELECT max(us) - 600000000 AS w FROM agent_events),
        judged AS (SELECT *, last_type = 'git_commit' AS done FROM sessions, mark)
        SELECT session_id, session_token, agent_id, CASE WHEN done THEN 'completed' ELSE 'timed_out' END AS status, project_dir, git_branch,
          started_at_us, CASE WHEN done THEN last_event_at_us ELSE last_event_at_us + {_12H} END AS ended_at_us, last_event_at_us, event_count
        FROM judged WHERE CASE WHEN done THEN last_event_at_us < w ELSE last_event_at_us + {_12H} < w END""",
    "stream_trace_relink": _CORRELATE,
    "edges_spans": f"""WITH {_EVENTS}, {_SYSTEM}, x AS (SELECT event_id, trace_id, span_id, parent_span_id FROM agent_events
          UNION ALL SELECT event_id, trace_id, span_id, parent_span_id FROM system_events)
        SELECT c.trace_id, p.event_id AS parent_id, c.event_id AS child_id FROM x c JOIN x p
        ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.trace_id <> '' AND p.span_id <> ''""",
    "calls_enriched_mixed": f"""WITH {_EVENTS} SELECT event_id,
        CASE WHEN tool_type = 'mcp' AND num % 5 <> 0 THEN 'git' END AS mcp_server, num % 5 = 0 AS is_subagent,
        CASE WHEN num % 7 = 0 AND severity = 'info' THEN 'error' ELSE severity END AS severity FROM agent_events""",
    "hybrid_retrieval": f"""WITH RECURSIVE {_EVENTS},
        cause AS (SELECT p.event_id AS a, c.event_id AS b FROM agent_events c JOIN agent_events p
          ON c.spawned_by = p.event_id OR (c.trace_id = p.trace_id AND c.parent_span_id = p.span_id)),
        edge AS (SELECT a, b FROM cause WHERE a <> b UNION SELECT b, a FROM cause WHERE a <> b),
        walk AS (SELECT CAST(vec_id AS VARCHAR) AS query, CAST(vec_id AS VARCHAR) AS id, 0 AS hops FROM embeddings
          UNION SELECT query, b, hops + 1 FROM walk JOIN edge ON a = id WHERE hops < 3),
        near AS (SELECT query, id, min(hops) AS hops FROM walk GROUP BY ALL),
        scored AS ({_VECTORS.format(id="CAST(c.vec_id AS VARCHAR) AS id")} FROM embeddings q, embeddings c, agent_events e
          WHERE q.vec_id <> c.vec_id AND e.num = c.vec_id AND e.severity <> 'error'),
        alike AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS by_vector FROM scored),
        linked AS (SELECT s.query_id, s.id, n.hops, row_number() OVER (PARTITION BY s.query_id ORDER BY n.hops, s.sim DESC, s.id) AS by_hops
          FROM scored s JOIN near n ON n.query = CAST(s.query_id AS VARCHAR) AND n.id = s.id),
        fused AS (SELECT a.query_id, a.id, CASE WHEN by_hops <= 50 THEN hops END AS hops, a.sim,
            round(coalesce(CASE WHEN by_hops <= 50 THEN 1.0::DOUBLE / (60 + by_hops) END, 0) +
                  coalesce(CASE WHEN by_vector <= 50 THEN 1.0::DOUBLE / (60 + by_vector) END, 0), 12) AS score
          FROM alike a LEFT JOIN linked l ON l.query_id = a.query_id AND l.id = a.id WHERE by_vector <= 50 OR by_hops <= 50),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused)
        SELECT query_id, rank, id, hops, sim AS similarity, score FROM best WHERE rank <= 10""",
}
for _name, _same in (("agents_merged_by_time", "agents_merged"), ("retention_removed", "retention_10d"), ("memory_compacted", "memory_entries"),
                     ("stream_agent_sessions", "agents_merged"), ("memory_search_indexed", "memory_search_top"),
                     ("memory_recall_indexed", "memory_recall")):
    ORACLES[_name] = ORACLES[_same]
