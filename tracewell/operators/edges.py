"""Relations between events, sessions, agents and files, as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordering import number_rows
from tracewell.operators.rollups import file_path
from tracewell.operators.traces import spawn_edges


def followed_by(events: DataFrame) -> DataFrame:
    """Each event and the next one of its session."""
    numbered = number_rows(events.select("session_id", "event_id", "tool_name", "ts"), ["session_id"], "ts", "event_id", "n")
    later = numbered.select("session_id", (F.col("n") - 1).alias("n"), F.col("event_id").alias("to_id"), F.col("tool_name").alias("to_tool"))
    return numbered.join(later, ["session_id", "n"]).select(
        "session_id", F.col("event_id").alias("from_id"), "to_id", F.col("tool_name").alias("from_tool"), "to_tool")


def tool_patterns(events: DataFrame) -> DataFrame:
    """How often one tool directly follows another within sessions."""
    return followed_by(events).groupBy("from_tool", "to_tool").agg(F.count(F.lit(1)).alias("times"))


def touched(events: DataFrame) -> DataFrame:
    """Events and the file each worked on."""
    return events.select("event_id", file_path().alias("path")).where(F.col("path").isNotNull())


def span_edges(events: DataFrame) -> DataFrame:
    """Parent and child events by span, within a trace; empty ids name nothing.

    Takes agent events, system events, or both as ``event_layers`` gives them.
    """
    child = events.where((F.col("trace_id") != "") & (F.col("parent_span_id") != "")).select(
        "trace_id", F.col("parent_span_id").alias("span_id"), F.col("event_id").alias("child_id"))
    parent = events.where((F.col("trace_id") != "") & (F.col("span_id") != "")).select("trace_id", "span_id", F.col("event_id").alias("parent_id"))
    return child.join(parent, ["trace_id", "span_id"]).select("trace_id", "parent_id", "child_id")


def caused_by(events: DataFrame) -> DataFrame:
    """Causes of events: what spawned them, and the event of their parent span."""
    return spawn_edges(events).select("parent_id", "child_id").unionByName(span_edges(events).select("parent_id", "child_id")).distinct()


def owns(events: DataFrame) -> DataFrame:
    return events.select("agent_id", "session_id").distinct()


def spawned_sessions(events: DataFrame) -> DataFrame:
    """Sessions with an event that spawned an event of another session."""
    of = events.select(F.col("event_id").alias("id"), "session_id")
    parent = of.select(F.col("id").alias("parent_id"), F.col("session_id").alias("parent_session"))
    child = of.select(F.col("id").alias("child_id"), F.col("session_id").alias("child_session"))
    return spawn_edges(events).join(parent, "parent_id").join(child, "child_id") \
        .where(F.col("parent_session") != F.col("child_session")).select("parent_session", "child_session").distinct()


def mcp_server(tool: Column) -> Column:
    """Server part of ``mcp__server__tool``, NULL for other tools."""
    return F.nullif(F.regexp_extract(tool, r"\Amcp__(.+?)__", 1), F.lit(""))


def enrich_calls(events: DataFrame) -> DataFrame:
    """Server name, sub-agent flag and severity inferred from the tool's output."""
    failed = F.coalesce(F.get_json_object("result", "$.error").isNotNull(), F.lit(False))
    return events.withColumns({
        "mcp_server": F.coalesce("mcp_server", mcp_server(F.col("tool_name"))),
        "is_subagent": F.coalesce(F.col("tool_name") == "Agent", F.lit(False)),
        "severity": F.when(failed & (F.col("severity") == "info"), "error").otherwise(F.col("severity")),
    })
