"""Literal tables for the column functions."""

import json
import string

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars as s
from tracewell.functions.anyvalue import any_string, any_value, service_name


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").repartition(2)
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_log_severity(spark):
    expected = {1: "debug", 4: "debug", 5: "info", 8: "info", 9: "warn", 12: "warn", 13: "error", 16: "error", 17: "fatal",
                21: "fatal", 0: "info", -1: "info", None: "info"}
    assert apply(spark, s.log_severity, list(expected), "bigint") == list(expected.values())


def test_span_severity(spark):
    assert apply(spark, s.span_severity, [0, 1, 2, 3, None], "bigint") == ["info", "info", "error", "info", "info"]


def test_duration(spark):
    rows = [("1000000000000000000", "1000000000500000000", 500), ("5", "5", None), ("9", "5", None), ("0", "999999", 0),
            ("x", "5", None), ("", "", None), ("1", " 5000000", None), ("-1000000", "1000000", 2)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")
    got = [r.d for r in df.select("i", s.duration_ms(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == [r[2] for r in rows]


def test_nanos_to_ts(spark):
    fallback = F.timestamp_micros(F.lit(77))
    got = apply(spark, lambda x: F.unix_micros(s.nanos_to_ts(x, fallback)),
                ["1234567890123456789", "1999", "-1", "0", "", "abc", "99999999999999999999"])
    assert got == [1234567890123456, 1, -1, 77, 77, 77, 77]


def test_nanos_past_a_bigint(spark):
    fallback = F.timestamp_micros(F.lit(77))
    got = apply(spark, lambda x: F.unix_micros(s.nanos_to_ts(x, fallback)),
                ["9223372036854775807", "9223372036854775808", "+0011424067200000001007", "18446744073709551615", "18446744073709551616",
                 "-9223372036854775809", "9223372036854775808.0", " 9223372036854775808", "9" * 5000])
    assert got == [9223372036854775, 9223372036854775, 11424067200000001, 18446744073709551, 77, 77, 77, 77, 77]


def test_hex_id(spark):
    assert apply(spark, s.hex_id, ["ABcd", "abc", "", "xy", "AB\n", None]) == ["abcd", "abc", "", "xy", "AB\n", None]


def test_short_float(spark):
    expected = {1e6: "1e+06", 0.5: "0.5", 5.0: "5", 123456.0: "123456", 1234567.0: "1.234567e+06", 1e-5: "1e-05", 0.0001: "0.0001",
                0.00012: "0.00012", 1e21: "1e+21", -2.5: "-2.5", 0.0: "0", 100.0: "100", 1.5e-7: "1.5e-07", 1e100: "1e+100",
                999999.5: "999999.5", 0.1: "0.1", 0.001: "0.001"}
    assert apply(spark, s.short_float, list(expected), "double") == list(expected.values())
    assert apply(spark, s.short_float, [-0.0, None], "double") == ["-0", None]


def test_tool_classification(spark):
    names = ["Bash", "mcp__git__Commit", "MultiEdit", "ReadEdit", "NotebookRead", "Grep", "MCP__x"]
    assert apply(spark, s.event_type, names) == ["tool_call", "git_commit"] + ["tool_call"] * 5
    assert apply(spark, s.tool_type, names) == ["builtin", "mcp"] + ["builtin"] * 5
    assert apply(spark, s.tool_message, names) == [
        "Executed command via Bash", "Git commit via mcp__git__Commit", "Edited file via MultiEdit", "Edited file via ReadEdit",
        "Read file via NotebookRead", "Used Grep", "Used MCP__x"]


def test_sensitive_keys(spark):
    keys = ["password", "DB_Passwd", "author", "max_tokens", "API_KEY", "name", "pwd1", "private_key_id", "key"]
    assert apply(spark, s.is_sensitive, keys) == [True, True, True, True, True, False, True, True, False]
    assert apply(spark, lambda k: s.is_sensitive(k, ["name"]), ["Name", "token"]) == [True, False]


def test_agent_ids(spark):
    """Every ASCII character alone and within an id, some beyond ASCII, and the lengths around the limit."""
    allowed = set(string.ascii_letters + string.digits + "-_")
    chars = [chr(i) for i in range(128)] + ["\u00aa", "\u00e9", "\u0661", "\u4e2d", "\U0001f600"]
    ids = [None, "", *chars, *(f"z{c}8" for c in chars), *("k" * n for n in (127, 128, 129, 4000))]
    expected = [i is not None and 0 < len(i) <= 128 and set(i) <= allowed for i in ids]
    assert apply(spark, s.is_valid_agent_id, ids) == expected


def test_default_agent_id(spark):
    assert apply(spark, lambda a: s.default_agent_id(a, F.lit("h1")), ["x", "", None]) == ["x", "claude-code-h1", "claude-code-h1"]


def test_masking(spark):
    urls = {"postgres://user:secret@localhost/db": "postgres://user:***@localhost/db", "postgres://localhost/db": "postgres://localhost/db",
            "": "", "http://a:b@c@d": "http://a:***@c@d", "http://user@host:5": "http://user@host:5", "no scheme a:b@c": "no scheme a:b@c",
            "x://y://u:p@h": "x://y:***@h", "a://u:p:q@h\n": "a://u:***@h\n"}
    assert apply(spark, s.mask_url, list(urls)) == list(urls.values())
    assert apply(spark, s.mask_secret, ["abc", "", None]) == ["***", "", None]


def test_int_text(spark):
    texts = ["5", "-7", "+3", "x", "", "99999999999999999999", "-99999999999999999999", "1.5", "007", "-0"]
    got = apply(spark, lambda x: any_value(F.parse_json(F.concat(F.lit('{"intValue":"'), x, F.lit('"}')))).cast("bigint"), texts)
    assert got == [5, -7, 3, 0, 0, 2**63 - 1, -(2**63), 0, 7, 0]


def test_any_value(spark):
    deep = '{"arrayValue":{"values":[' * 30 + '{"stringValue":"x"}' + "]}}" * 30
    cases = [
        ('{"stringValue":"a\\"b"}', 'a"b'), ('{"intValue":"12"}', 12), ('{"intValue":"x"}', 0), ('{"boolValue":false}', False),
        ('{"doubleValue":1.5}', 1.5), ('{"doubleValue":1e300}', 1e300), ("{}", None), ("null", None),
        ('{"arrayValue":{"values":[{"intValue":"1"},{},{"stringValue":""}]}}', [1, None, ""]), ('{"arrayValue":{}}', []),
        ('{"kvlistValue":{"values":[{"key":"a","value":{"intValue":"1"}},{"key":"a"},{"key":"b","value":{"boolValue":true}}]}}',
         {"a": None, "b": True}),
        ('{"boolValue":true,"stringValue":"s"}', "s"), ('{"kvlistValue":{"values":null},"doubleValue":null}', {}),
    ]
    got = apply(spark, lambda x: F.to_json(F.struct(any_value(F.parse_json(x)).alias("v"))), [c[0] for c in cases])
    for text, (source, expected) in zip(got, cases):
        assert json.loads(text).get("v") == expected, source
    wrong = ['{"stringValue":5}', '{"intValue":5}', '{"boolValue":"true"}', '{"doubleValue":"1"}', '{"arrayValue":[]}', "5", '"x"',
             '{"stringValue":"a","intValue":5}', '{"arrayValue":{"values":[{"intValue":1}]}}', '{"kvlistValue":{"values":[{"key":1}]}}']
    assert apply(spark, lambda x: any_value(F.parse_json(x)).isNull(), wrong) == [True] * len(wrong)
    nested = json.loads(apply(spark, lambda x: F.to_json(F.struct(any_value(F.parse_json(x)).alias("v"))), [deep])[0])["v"]
    for _ in range(30):
        nested = nested[0]
    assert nested == "x"


def test_any_string(spark):
    texts = ['{"stringValue":"a"}', '{"intValue":"012"}', '{"boolValue":true}', '{"doubleValue":1000000}', '{"arrayValue":{}}', "{}"]
    assert apply(spark, lambda x: any_string(F.parse_json(x)), texts) == ["a", "012", "true", "1e+06", "", ""]


@pytest.mark.parametrize("attributes, expected", [
    ('[{"key":"x"},{"key":"service.name","value":{"stringValue":"a"}},{"key":"service.name","value":{"stringValue":"b"}}]', "a"),
    ('[{"key":"service.name","value":{"arrayValue":{}}}]', ""), ("[]", "unknown"), ("null", "unknown"),
])
def test_service_name(spark, attributes, expected):
    assert apply(spark, lambda x: service_name(F.parse_json(x)), [attributes]) == [expected]
