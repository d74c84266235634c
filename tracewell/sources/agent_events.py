"""Agent events sent as JSON, one object or a list per payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expr import let
from tracewell.functions.scalars import is_valid_agent_id, null_if_empty
from tracewell.sources.payloads import MALFORMED, Decoded, parse_wrapped

INVALID_AGENT, INVALID_TIME = "invalid_agent_id", "invalid_timestamp"
_EVENT = (
    "agent_id string, session_token string, timestamp string, event_type string, severity string, "
    "tool_name string, tool_type string, mcp_server string, message string, params variant, result variant, "
    "context variant, duration_ms bigint, tags array<string>, trace_id string, span_id string, "
    "parent_span_id string, spawned_by string"
)


def read_agent_events(payloads: DataFrame) -> Decoded:
    """Decode ``payload_id, body, captured_at`` rows; a payload is taken whole or not at all.

    An event without a timestamp takes the capture time, one without a severity
    is ``info``. Every agent id must be valid and every given timestamp
    readable. Empty trace, span and spawning ids are NULL.
    """
    body = F.col("body")
    is_list = F.ltrim(body).startswith("[")
    wrapped = F.when(is_list, F.concat(F.lit('{"r":'), body, F.lit("}"))) \
        .otherwise(F.concat(F.lit('{"r":['), body, F.lit("]}")))
    parsed = payloads.select("payload_id", "body", "captured_at", parse_wrapped(wrapped, _EVENT).alias("parsed"))
    events = F.filter(F.col("parsed.r"), lambda e: e.isNotNull())
    broken = F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull() | (
        (F.length(body) > 0) & ~is_list & (F.coalesce(F.size("parsed.r"), F.lit(0)) != 1))
    reason = F.coalesce(
        F.when(broken, MALFORMED),
        F.when(F.exists(events, lambda e: ~is_valid_agent_id(e["agent_id"])), INVALID_AGENT),
        F.when(F.exists(events, lambda e: null_if_empty(e["timestamp"]).isNotNull() & e["timestamp"].try_cast("timestamp").isNull()), INVALID_TIME))
    decoded = parsed.select("payload_id", "body", "captured_at", F.struct(
        reason.alias("reason"), F.coalesce(events, F.slice("parsed.r", 1, 0)).alias("events")).alias("d"))
    rows = let(F.col("d"), lambda d: F.when(d["reason"].isNull(), d["events"]))
    e = F.col("e")
    accepted = decoded.select("payload_id", "captured_at", F.posexplode(rows).alias("pos", "e")).select(
        F.sha2(F.concat_ws(":", F.lit("event"), "payload_id", "pos"), 256).alias("event_id"),
        e["agent_id"].alias("agent_id"),
        F.coalesce(e["session_token"], F.lit("")).alias("session_token"),
        F.coalesce(e["timestamp"].try_cast("timestamp"), F.col("captured_at")).alias("ts"),
        e["event_type"].alias("event_type"),
        F.coalesce(null_if_empty(e["severity"]), F.lit("info")).alias("severity"),
        *[e[c].alias(c) for c in ("tool_name", "tool_type", "mcp_server", "message")],
        *[F.to_json(e[c]).alias(c) for c in ("params", "result", "context")],
        *[e[c].alias(c) for c in ("duration_ms", "tags")],
        *[null_if_empty(e[c]).alias(c) for c in ("trace_id", "span_id", "parent_span_id", "spawned_by")],
        F.col("captured_at").alias("created_at"),
    )
    refused = decoded.where(F.col("d.reason").isNotNull()).select(
        "payload_id", "body", "captured_at", F.col("d.reason").alias("reason"))
    return Decoded(accepted, refused)
