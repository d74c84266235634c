"""OTLP/JSON export requests to ``system_events`` rows.

Payloads are rows ``payload_id, body, ingested_at``. A request is decoded as a
whole inside its own row: one wrong field anywhere refuses all of it, and the
decision needs no shuffle. Decoding is one narrow stage: parse, convert, explode.

Known differences from a case-insensitive, last-key-wins decoder: field names
are matched case-sensitively, an object with a repeated key inside a typed
value is refused as malformed, and times are unsigned 64-bit nanoseconds, where
a signed decoder replaces those from the year 2262 on by the ingest time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.anyvalue import (
    WRONG, any_string, any_wrong, doubtful, finish_odd, finished_json, list_json, list_text, lone_value_json, lone_value_text, not_string,
    odd_texts, service_name, text_of,
)
from tracewell.functions.scalars import (
    duration_ms, hex_id, log_severity, nanos_to_ts, null_if_empty, span_severity,
)
from tracewell.sources.payloads import MALFORMED, WRONG_TYPE, Decoded, not_one_request, parse_request, wrong_text

SOURCE_TYPE = "otlp"

# Leaves that must be JSON strings stay VARIANT: the parser would turn a number
# into text. Integers and containers are checked by the parser itself.
_SPAN = (
    "traceId variant, spanId variant, parentSpanId variant, name variant, startTimeUnixNano variant, "
    "endTimeUnixNano variant, status struct<code bigint, message variant>, attributes variant"
)
_LOG = (
    "timeUnixNano variant, severityNumber bigint, severityText variant, body variant, traceId variant, "
    "spanId variant, attributes variant"
)
TRACE_REQUEST = (
    f"resourceSpans array<struct<resource struct<attributes variant>, scopeSpans array<struct<spans array<struct<{_SPAN}>>>>>>"
)
LOG_REQUEST = (
    f"resourceLogs array<struct<resource struct<attributes variant>, scopeLogs array<struct<logRecords array<struct<{_LOG}>>>>>>"
)


def _flat(nested: Column) -> Column:
    return F.flatten(F.filter(nested, lambda x: x.isNotNull()))


def _text(leaf: Column) -> Column:
    return hex_id(text_of(leaf))


def _span_wrong(span: Column) -> Column:
    wrong = wrong_text(span, ("traceId", "spanId", "parentSpanId", "name", "startTimeUnixNano", "endTimeUnixNano"))
    return wrong | not_string(span["status"]["message"])


def _log_wrong(rec: Column) -> Column:
    return wrong_text(rec, ("timeUnixNano", "severityText", "traceId", "spanId"))


def _span_record(span: Column) -> Column:
    start, end = text_of(span["startTimeUnixNano"]), text_of(span["endTimeUnixNano"])
    return F.struct(
        _span_wrong(span).alias("wrong"),
        start.alias("nanos"),
        _text(span["traceId"]).alias("trace_id"),
        _text(span["spanId"]).alias("span_id"),
        null_if_empty(_text(span["parentSpanId"])).alias("parent_span_id"),
        span_severity(span["status"]["code"]).alias("severity"),
        text_of(span["name"]).alias("event_name"),
        F.lit(None).cast("string").alias("message"),
        duration_ms(start, end).alias("duration_ms"),
    )


def _log_record(rec: Column) -> Column:
    return F.struct(
        _log_wrong(rec).alias("wrong"),
        text_of(rec["timeUnixNano"]).alias("nanos"),
        null_if_empty(_text(rec["traceId"])).alias("trace_id"),
        null_if_empty(_text(rec["spanId"])).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        log_severity(rec["severityNumber"]).alias("severity"),
        F.lit(None).cast("string").alias("event_name"),
        null_if_empty(any_string(rec["body"])).alias("message"),
        F.lit(None).cast("bigint").alias("duration_ms"),
    )


def _decode(payloads: DataFrame, schema: str, top: str, scopes: str, leaf: str, record, checked) -> DataFrame:
    """Decode each payload inside its row, in one stage.

    ``checked`` gives a typed value of the record that is read but not stored.
    """
    keep = ("payload_id", "body", "ingested_at")
    parsed = payloads.select(*keep, parse_request(F.col("body"), schema).alias("parsed"))
    blocks = F.get(F.col("parsed.r"), F.lit(0))[top]
    leaves = _flat(F.transform(blocks, lambda b, ri: _flat(F.transform(b[scopes], lambda s, si: F.transform(
        s[leaf], lambda rec, pi: F.struct(
            ri.alias("ri"), F.concat_ws(":", ri, si, pi).alias("position"),
            record(rec).alias("rec"), list_json(rec["attributes"]).alias("attributes"), checked(rec).alias("checked")))))))
    resources = F.transform(blocks, lambda b: F.struct(
        list_json(b["resource"]["attributes"]).alias("json"), service_name(b["resource"]["attributes"]).alias("service")))
    flat = parsed.select(
        *keep, F.when(not_one_request(F.col("parsed"), F.col("body")), MALFORMED).alias("refusal"),
        F.coalesce(resources, F.array()).alias("resources"), F.coalesce(leaves, F.array()).alias("leaves"),
    )
    texts = F.concat(
        F.transform("resources", lambda r: r["json"]),
        F.transform("leaves", lambda x: x["attributes"]), F.transform("leaves", lambda x: x["checked"]))
    finished = flat.select("*", odd_texts(texts).alias("odd")).select("*", finish_odd(F.col("odd")).alias("finished"))
    done = F.col("finished")
    # Only a payload with odd lists is rebuilt.
    has_odd = F.size("odd") > 0
    rebuilt = finished.select(
        *keep, "refusal",
        F.when(has_odd, F.transform("resources", lambda r: F.struct(
            finished_json(r["json"], done).alias("json"), r["service"].alias("service")))).otherwise(F.col("resources")).alias("resources"),
        F.when(has_odd, F.transform("leaves", lambda x: F.struct(
            x["ri"].alias("ri"), x["position"].alias("position"), x["rec"].alias("rec"),
            finished_json(x["attributes"], done).alias("attributes"),
            finished_json(x["checked"], done).alias("checked")))).otherwise(F.col("leaves")).alias("rows"),
    )
    wrong = F.exists("resources", lambda r: r["json"] == WRONG) | F.exists(
        "rows", lambda x: x["rec"]["wrong"] | (x["attributes"] == WRONG) | (x["checked"] == WRONG))
    return rebuilt.select(*keep, F.coalesce(F.col("refusal"), F.when(wrong, WRONG_TYPE)).alias("reason"), "resources", "rows")


def _judge(payloads: DataFrame, schema: str, top: str, scopes: str, leaf: str, wrong, typed) -> DataFrame:
    """One row per payload with ``reason``, as ``_decode`` gives it, without building the rows.

    ``typed`` gives the texts of a record's typed values. A text that is
    plainly right is not converted; the others are decided as in ``_decode``.
    """
    keep = ("payload_id", "body", "ingested_at")
    parsed = payloads.select(*keep, parse_request(F.col("body"), schema).alias("parsed"))
    blocks = F.get(F.col("parsed.r"), F.lit(0))[top]
    leaves = _flat(F.transform(blocks, lambda b: _flat(F.transform(b[scopes], lambda s: F.transform(
        s[leaf], lambda rec: F.struct(wrong(rec).alias("wrong"), F.array(*[doubtful(t) for t in typed(rec)]).alias("texts")))))))
    judged = parsed.select(
        *keep, F.when(not_one_request(F.col("parsed"), F.col("body")), MALFORMED).alias("refusal"),
        F.coalesce(F.transform(blocks, lambda b: doubtful(list_text(b["resource"]["attributes"]))), F.array()).alias("resources"),
        F.coalesce(leaves, F.array()).alias("leaves"))
    texts = F.concat("resources", F.flatten(F.transform("leaves", lambda x: x["texts"])))
    odd = judged.select(*keep, "refusal", F.exists("leaves", lambda x: x["wrong"]).alias("wrong"), odd_texts(texts).alias("odd"))
    finished = odd.select(*keep, "refusal", (any_wrong(F.col("odd")) | F.col("wrong")).alias("wrong"))
    return finished.select(*keep, F.coalesce(F.col("refusal"), F.when(F.col("wrong"), WRONG_TYPE)).alias("reason"))


def judge_traces(payloads: DataFrame) -> DataFrame:
    """One row per payload with ``reason``: the judgement of ``decode_traces`` for the refused side alone."""
    return _judge(payloads, TRACE_REQUEST, "resourceSpans", "scopeSpans", "spans", _span_wrong, lambda rec: [list_text(rec["attributes"])])


def judge_logs(payloads: DataFrame) -> DataFrame:
    return _judge(payloads, LOG_REQUEST, "resourceLogs", "scopeLogs", "logRecords", _log_wrong,
                  lambda rec: [list_text(rec["attributes"]), lone_value_text(rec["body"])])


def _nothing(rec: Column) -> Column:
    return F.lit("")


def decode_traces(payloads: DataFrame) -> DataFrame:
    """One row per payload with ``reason``, ``resources`` and ``rows``: a single
    pass that serves both the accepted and the refused side."""
    return _decode(payloads, TRACE_REQUEST, "resourceSpans", "scopeSpans", "spans", _span_record, _nothing)


def decode_logs(payloads: DataFrame) -> DataFrame:
    return _decode(payloads, LOG_REQUEST, "resourceLogs", "scopeLogs", "logRecords", _log_record,
                   lambda rec: lone_value_json(rec["body"]))


def accepted(decoded: DataFrame, signal: str) -> DataFrame:
    """Rows of the accepted payloads in the ``system_events`` shape.

    ``event_id`` is derived from the payload and the position in it, so a
    replayed or retried payload gives the same ids.
    """
    r, rec = F.col("r"), F.col("r.rec")
    resource = F.get(F.col("resources"), r["ri"])
    rows = F.explode(F.when(F.col("reason").isNull(), F.col("rows")))
    return decoded.select("payload_id", "ingested_at", "resources", rows.alias("r")).select(
        F.sha2(F.concat_ws(":", F.lit(signal), F.col("payload_id"), r["position"]), 256).alias("event_id"),
        nanos_to_ts(rec["nanos"], F.col("ingested_at")).alias("ts"),
        rec["trace_id"].alias("trace_id"),
        rec["span_id"].alias("span_id"),
        rec["parent_span_id"].alias("parent_span_id"),
        F.lit(SOURCE_TYPE).alias("source_type"),
        F.lit(signal).alias("signal"),
        resource["service"].alias("source_service"),
        rec["severity"].alias("severity"),
        rec["event_name"].alias("event_name"),
        rec["message"].alias("message"),
        r["attributes"].alias("attributes"),
        resource["json"].alias("resource"),
        rec["duration_ms"].alias("duration_ms"),
        F.lit(None).cast("string").alias("session_id"),
        F.col("ingested_at").alias("created_at"),
    )


def refused(decoded: DataFrame) -> DataFrame:
    """Refused payloads with the reason."""
    return decoded.where(F.col("reason").isNotNull()).select("payload_id", "body", "ingested_at", "reason")


def read_otlp_traces(payloads: DataFrame) -> Decoded:
    return Decoded(accepted(decode_traces(payloads), "trace"), refused(judge_traces(payloads)))


def read_otlp_logs(payloads: DataFrame) -> Decoded:
    return Decoded(accepted(decode_logs(payloads), "log"), refused(judge_logs(payloads)))
