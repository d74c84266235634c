import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources.agent_events import read_agent_events
from tracewell.sources.hooks import read_hook_events
from tracewell.sources.otlp import read_otlp_logs, read_otlp_traces
from tracewell.sources.sinks import append_events


def payloads(spark, bodies, time_col="ingested_at"):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "payload_id bigint, body string")
    return df.withColumn(time_col, F.timestamp_seconds(F.lit(1_700_000_000.25)))


def trace(**span):
    return json.dumps({"resourceSpans": [{
        "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "ledger-svc"}}]},
        "scopeSpans": [{"spans": [span]}]}]})


SPAN = {
    "traceId": "5BD1c0ffee00112233445566778899AA", "spanId": "c0dec0de00000017", "parentSpanId": "c0dec0de00000016",
    "name": "settle invoice", "startTimeUnixNano": "1650000000000000000", "endTimeUnixNano": "1650000000230000000",
    "status": {"code": 1}, "attributes": [{"key": "invoice.kind", "value": {"stringValue": "credit"}}],
}


def test_span(spark):
    row = read_otlp_traces(payloads(spark, [trace(**SPAN)])).events.collect()[0]
    assert (row.source_service, row.source_type, row.signal) == ("ledger-svc", "otlp", "trace")
    assert (row.trace_id, row.span_id, row.parent_span_id) == (SPAN["traceId"].lower(), SPAN["spanId"], SPAN["parentSpanId"])
    assert (row.event_name, row.severity, row.duration_ms) == (SPAN["name"], "info", 230)
    assert json.loads(row.attributes) == {"invoice.kind": "credit"} and json.loads(row.resource) == {"service.name": "ledger-svc"}
    assert row.session_id is None and row.message is None


def test_bare_span_takes_defaults(spark):
    body = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"status":{"code":2}},null]}]}]}'
    rows = read_otlp_traces(payloads(spark, [body])).events.withColumn("us", F.unix_micros("ts")).orderBy("severity").collect()
    assert [r.severity for r in rows] == ["error", "info"]
    for row in rows:
        assert (row.trace_id, row.span_id, row.parent_span_id, row.event_name) == ("", "", None, "")
        assert row.source_service == "unknown" and row.duration_ms is None and row.attributes == "{}"
        assert row.us == 1_700_000_000_250_000


def test_log(spark):
    body = json.dumps({"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [
        {"timeUnixNano": "1650000000000000000", "severityNumber": 9, "severityText": "WARN", "body": {"stringValue": "invoice is late"},
         "traceId": "5bd1c0ffee00112233445566778899aa", "spanId": "", "attributes": [{"key": "c", "value": {"intValue": "4"}}]},
        {"body": {"kvlistValue": {"values": []}}}]}]}]})
    first, second = read_otlp_logs(payloads(spark, [body])).events.orderBy(F.col("message").isNull()).collect()
    assert (first.message, first.severity, first.source_service, first.span_id) == ("invoice is late", "warn", "unknown", None)
    assert json.loads(first.attributes) == {"c": 4}
    assert (second.message, second.severity, second.trace_id) == (None, "info", None)


GOOD = trace(**SPAN)
REFUSED = {
    "{not json": "malformed", GOOD + " x": "malformed", GOOD + GOOD: "malformed", "[]": "malformed", "5": "malformed", "  ": "malformed",
    '{"resourceSpans":5}': "malformed", '{"resourceSpans":[{"scopeSpans":{}}]}': "malformed",
    trace(**{**SPAN, "status": {"code": "2"}}): "malformed", trace(**{**SPAN, "status": {"code": 1.5}}): "malformed",
    trace(**{**SPAN, "startTimeUnixNano": 5}): "wrong_type", trace(**{**SPAN, "name": {}}): "wrong_type",
    trace(**{**SPAN, "attributes": {"a": 1}}): "wrong_type",
    trace(**{**SPAN, "attributes": [{"key": "a", "value": {"intValue": 5}}]}): "wrong_type",
    trace(**{**SPAN, "attributes": [{"key": 5}]}): "wrong_type",
    '{"resourceSpans":[{"resource":{"attributes":[{"key":"a","value":{"boolValue":"x"}}]}}]}': "wrong_type",
}
EMPTY = ["", "null", "{}", '{"resourceSpans":[]}', '{"resourceSpans":null}', '{"resourceSpans":[null,{"scopeSpans":[null]}]}']


def test_refused_whole(spark):
    mixed = json.loads(GOOD)
    mixed["resourceSpans"].append(json.loads(trace(**{**SPAN, "spanId": 7}))["resourceSpans"][0])
    bodies = [*REFUSED, json.dumps(mixed), *EMPTY, GOOD]
    decoded = read_otlp_traces(payloads(spark, bodies))
    reasons = {bodies[r.payload_id]: r.reason for r in decoded.rejects.collect()}
    assert reasons == {**REFUSED, json.dumps(mixed): "wrong_type"}
    assert decoded.events.count() == 1


def test_attribute_lists(spark):
    def attr(key, **value):
        return {"key": key, "value": value}

    lists = {
        "plain": ([attr("b", intValue="7"), attr("a", stringValue='q"\\u')], {"a": 'q"\\u', "b": 7}),
        "repeat": ([attr("a", stringValue="x"), attr("b", boolValue=True), attr("a", doubleValue=2.5)], {"a": 2.5, "b": True}),
        "nested": ([attr("a", arrayValue={"values": [{"kvlistValue": {"values": [attr("k", intValue="1")]}}]})], {"a": [{"k": 1}]}),
        "null": ([{"key": "a", "value": None}, {"key": "b"}, None], {"a": None, "b": None, "": None}),
        "clamped": ([attr("a", intValue="99999999999999999999"), attr("b", intValue="1x")], {"a": 2**63 - 1, "b": 0}),
        "huge": ([attr("a", intValue="9" * 5000), attr("b", intValue="-" + "7" * 5000), attr("a", intValue="0" * 5000 + "3")], {"a": 3, "b": -2**63}),
    }
    bodies = [trace(**{**SPAN, "name": n, "attributes": a}) for n, (a, _) in lists.items()]
    rows = read_otlp_traces(payloads(spark, bodies)).events.collect()
    assert {r.event_name: json.loads(r.attributes) for r in rows} == {n: e for n, (_, e) in lists.items()}


def test_ids_are_stable_and_unique(spark):
    body = json.loads(GOOD)
    body["resourceSpans"][0]["scopeSpans"] *= 2
    df = payloads(spark, [json.dumps(body)] * 3)
    ids = sorted(r.event_id for r in read_otlp_traces(df).events.collect())
    assert len(set(ids)) == 6
    assert ids == sorted(r.event_id for r in read_otlp_traces(df.repartition(3)).events.collect())


def test_hooks(spark):
    bodies = [
        json.dumps({"tool_name": "Edit", "tool_input": {"file_path": "a", "api_key": "k"}, "tool_output": None, "duration_ms": 12,
                    "session_id": "s", "project_dir": "/p"}),
        '{"tool_name":"mcp__git__commit"}', '{"tool_name":""}', "{}", "null", "", '{"tool_name":"X","tool_output":"done"}', '{"tool_name":5}',
        '{"tool_name":"X","duration_ms":1.5}', '{"tool_name":"X"',
    ]
    decoded = read_hook_events(payloads(spark, bodies, "captured_at"), F.lit("me"))
    edit, commit = decoded.events.orderBy(F.col("tool_type")).collect()
    assert json.loads(edit.params) == {"file_path": "a", "api_key": "[REDACTED]"} and edit.result == "{}"
    assert json.loads(edit.context) == {"project_dir": "/p", "git_branch": ""}
    assert (edit.agent_id, edit.session_token, edit.duration_ms, edit.ts.microsecond) == ("me", "s", 12, 0)
    assert (commit.event_type, commit.tool_type, commit.params, commit.duration_ms) == ("git_commit", "mcp", "{}", 0)
    reasons = {r.payload_id: r.reason for r in decoded.rejects.collect()}
    assert reasons == {2: "no_tool_name", 3: "no_tool_name", 4: "no_tool_name", 5: "no_tool_name", 6: "wrong_type", 7: "wrong_type",
                       8: "malformed", 9: "malformed"}


def test_agent_events_single_or_list(spark):
    one = {"agent_id": "a", "session_token": "s", "timestamp": "2024-01-01T00:00:00Z", "event_type": "tool_call", "tool_name": "Bash",
           "tags": ["x"], "params": {"b": 1}}
    bodies = [json.dumps(one), json.dumps([one]), json.dumps([one, {"agent_id": "b"}]), "[]", "", '[{"agent_id":"no good"},{"agent_id":"a"}]',
              json.dumps(one) * 2, json.dumps([one]) + "x", "{",
              json.dumps({**one, "timestamp": "yesterday"})]
    decoded = read_agent_events(payloads(spark, bodies, "captured_at"))
    rows = [r.asDict() for r in decoded.events.drop("event_id").collect()]
    assert len(rows) == 4 and rows.count(rows[0]) == 3
    assert {r.payload_id: r.reason for r in decoded.rejects.collect()} == {
        5: "invalid_agent_id", 6: "malformed", 7: "malformed", 8: "malformed", 9: "invalid_timestamp"}


@pytest.mark.parametrize("times", [1, 2])
def test_append(spark, tmp_path, times):
    events = read_otlp_traces(payloads(spark, [GOOD, GOOD])).events
    for _ in range(times):
        assert append_events(events, str(tmp_path / "t")) == 2
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 2 * times and stored.first().event_date.isoformat() == "2022-04-15"
