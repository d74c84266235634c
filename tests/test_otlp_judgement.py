import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources import otlp
from tracewell.sources.otlp import decode_logs, decode_traces, judge_logs, judge_traces, read_otlp_logs, read_otlp_traces, refused

VALUES = [
    '{"stringValue":"x"}', '{"stringValue":"\\u0041\\n\\"\\\\"}', '{"stringValue":5}', '{"intValue":"12"}', '{"intValue":12}', '{"intValue":"x"}',
    '{"intValue":"99999999999999999999"}', '{"boolValue":true}', '{"boolValue":"true"}', '{"doubleValue":1.5}', '{"doubleValue":"1.5"}',
    '{"doubleValue":1e999}', '{"doubleValue":' + "9" * 299 + "}", '{"doubleValue":' + "9" * 400 + "}", '{"doubleValue":-0.0}', "{}", "null", "[]", "7",
    '{"arrayValue":{"values":[{"stringValue":"a"},{"intValue":1}]}}', '{"arrayValue":{"values":[{"stringValue":"a"},null]}}',
    '{"kvlistValue":{"values":[{"key":"n","value":{"boolValue":0}}]}}', '{"kvlistValue":{"values":{}}}', '{"stringValue":"a","intValue":3}',
]
LISTS = [f'[{{"key":"k","value":{v}}}]' for v in VALUES]
LISTS += [f'[{{"key":"k","value":{v}}},{{"key":"k","value":{{"boolValue":true}}}}]' for v in VALUES]
LISTS += ["[]", "null", "{}", '"x"', "[null]", '[{"key":1,"value":{"boolValue":true}}]', '[{"value":{"boolValue":true}}]', '[{"key":"a"}]', "[7]"]
FIELDS = ['"name":5', '"status":{"message":5}', '"status":{"code":"x"}', '"traceId":null', '"timeUnixNano":5', '"severityText":{}', '"spanId":[1]']


def bodies(top, scopes, leaf):
    def request(record, resource='{"attributes":[]}'):
        return f'{{"{top}":[{{"resource":{resource},"{scopes}":[{{"{leaf}":[{{"name":"ok"}},{record}]}}]}}]}}'

    out = [request(f'{{"attributes":{x}}}') for x in LISTS] + [request("{}", f'{{"attributes":{x}}}') for x in LISTS]
    out += [request(f"{{{x}}}") for x in FIELDS] + [request(f'{{"body":{v}}}') for v in VALUES]
    out += ["", None, "{", "[]", "null", "{} {}", "7", f'{{"{top}":[]}}', f'{{"{top}":null}}', f'{{"{top}":[null]}}', f'{{"{top}":7}}', request("null"),
            f'{{"{top}":[{{"{scopes}":[null,{{"{leaf}":null}}]}}]}}']
    return out + [out[0][:-3], out[0].replace('"ok"', "5")]


@pytest.mark.parametrize("judge, decode, names", [
    (judge_traces, decode_traces, ("resourceSpans", "scopeSpans", "spans")), (judge_logs, decode_logs, ("resourceLogs", "scopeLogs", "logRecords"))])
def test_judged_as_decoded(spark, judge, decode, names):
    rows = [(k, b) for k, b in enumerate(bodies(*names))]
    df = spark.createDataFrame(rows, "payload_id long, body string").withColumn("ingested_at", F.timestamp_seconds(F.lit(0))).repartition(2)
    want = {r.payload_id: r.reason for r in decode(df).select("payload_id", "reason").collect()}
    got = {r.payload_id: r.reason for r in judge(df).select("payload_id", "reason").collect()}
    assert {k: (rows[k][1], got[k], want[k]) for k in want if got[k] != want[k]} == {} and len(got) == len(rows)
    assert {"malformed", "wrong_type", None} == set(want.values())
    assert refused(judge(df)).columns == refused(decode(df)).columns


@pytest.mark.parametrize("read", [read_otlp_traces, read_otlp_logs])
def test_the_refused_side_builds_no_rows(spark, monkeypatch, read):
    df = spark.createDataFrame([(1, json.dumps({"resourceSpans": []}))], "payload_id long, body string").withColumn("ingested_at", F.current_timestamp())
    made = []
    monkeypatch.setattr(otlp, "refused", lambda decoded: made.append(decoded.columns) or decoded)
    read(df)
    assert made == [["payload_id", "body", "ingested_at", "reason"]]
