"""Tool-call hook payloads, one JSON object each, to ``agent_events`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.anyvalue import kind, text_of
from tracewell.functions.expr import keep_rows
from tracewell.functions.redaction import with_redacted
from tracewell.functions.scalars import context_json, event_type, tool_message, tool_type
from tracewell.sources.payloads import MALFORMED, WRONG_TYPE, Decoded, not_one_request, parse_request, wrong_text

NO_TOOL_NAME = "no_tool_name"
_HOOK = (
    "tool_name variant, tool_input variant, tool_output variant, duration_ms bigint, "
    "session_id variant, project_dir variant, git_branch variant"
)


def _not_object(v: Column) -> Column:
    return v.isNotNull() & ~(kind(v).startswith("OBJECT") | (kind(v) == "VOID"))


def read_hook_events(payloads: DataFrame, agent_id: Column) -> Decoded:
    """Decode ``payload_id, body, captured_at`` rows; ``agent_id`` is a column of them.

    Secrets in the tool's input and output are redacted here, before anything
    is stored. A malformed payload, or one without a tool name, yields no event.
    """
    hook = F.get(F.col("parsed.r"), F.lit(0))
    parsed = payloads.select(
        "payload_id", "body", "captured_at", agent_id.alias("agent_id"),
        parse_request(F.col("body"), _HOOK).alias("parsed"),
    ).select(
        "payload_id", "body", "captured_at", "agent_id", hook.alias("hook"),
        hook["tool_input"].alias("tool_input"), hook["tool_output"].alias("tool_output"),
        F.when(not_one_request(F.col("parsed"), F.col("body")), MALFORMED).alias("refusal"),
    )
    h, tool = F.col("hook"), text_of(F.col("hook.tool_name"))
    wrong = wrong_text(h, ("tool_name", "session_id", "project_dir", "git_branch"))
    wrong = wrong | _not_object(F.col("tool_input")) | _not_object(F.col("tool_output"))
    reason = F.coalesce(
        F.col("refusal"), F.when(wrong, WRONG_TYPE), F.when(tool == "", NO_TOOL_NAME))
    context = context_json(text_of(h["project_dir"]), text_of(h["git_branch"]))
    none = F.lit(None).cast("string")
    redacted = with_redacted(parsed, {"params": "tool_input", "result": "tool_output"})
    events = keep_rows(redacted, reason.isNull(), [
        F.sha2(F.concat_ws(":", F.lit("hook"), F.col("payload_id")), 256).alias("event_id"),
        F.col("agent_id"),
        text_of(h["session_id"]).alias("session_token"),
        F.date_trunc("second", F.col("captured_at")).alias("ts"),
        event_type(tool).alias("event_type"),
        F.lit("info").alias("severity"),
        tool.alias("tool_name"),
        tool_type(tool).alias("tool_type"),
        none.alias("mcp_server"),
        tool_message(tool).alias("message"),
        F.col("params"),
        F.col("result"),
        context.alias("context"),
        F.coalesce(h["duration_ms"], F.lit(0)).alias("duration_ms"),
        F.lit(None).cast("array<string>").alias("tags"),
        none.alias("trace_id"), none.alias("span_id"), none.alias("parent_span_id"), none.alias("spawned_by"),
        F.col("captured_at").alias("created_at"),
    ])
    rejects = keep_rows(parsed, reason.isNotNull(), [
        F.col("payload_id"), F.col("body"), F.col("captured_at"), reason.alias("reason")])
    return Decoded(events, rejects)
