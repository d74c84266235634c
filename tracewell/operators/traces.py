"""Correlation of agent events with system events by trace, and trace trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.checkpoints import written


def _has_trace(trace_id: Column) -> Column:
    return F.coalesce(trace_id != "", F.lit(False))


def correlate(system: DataFrame, agent: DataFrame) -> DataFrame:
    """Give each system event the session of the earliest agent event of its trace.

    The agent side is reduced to one row per trace before the join. System
    events without a trace keep a NULL session; they get a key of their own, so
    that they do not all meet in one task.
    """
    first = F.min_by("session_id", F.struct("ts", "event_id"))
    owners = agent.where(_has_trace(F.col("trace_id"))).groupBy("trace_id").agg(first.alias("_session"))
    key = F.when(_has_trace(F.col("trace_id")), F.col("trace_id")).otherwise(F.concat(F.lit("~"), "event_id"))
    keyed = system.withColumn("_key", key)
    joined = keyed.join(owners.withColumnRenamed("trace_id", "_key"), "_key", "left")
    return joined.select(*[F.col("_session").alias(c) if c == "session_id" else F.col(c) for c in system.columns])


def event_layers(agent: DataFrame, system: DataFrame) -> DataFrame:
    """Agent and system events in one shape."""
    keys = ("event_id", "ts", "trace_id", "span_id", "parent_span_id")
    return agent.select(
        F.lit("agent").alias("layer"), *keys, "severity", F.col("tool_name").alias("name"), "message", "duration_ms",
    ).unionByName(system.select(
        F.lit("system").alias("layer"), *keys, "severity", F.col("event_name").alias("name"), "message", "duration_ms"))


def span_depths(nodes: DataFrame) -> DataFrame:
    """Depth of every ``(trace_id, span_id)`` in its tree, by pointer doubling.

    Each round joins every open span to the ancestor it has reached and doubles the
    distance: a tree of depth d takes log2(d) rounds, whatever its width. A span
    whose parent is unknown is a root. Only spans that are still open are written
    again; settled ones stay where they are. Rounds end when none is open, or
    when a round closes none: what is then left hangs in a cycle and has depth NULL.
    """
    keys = ["trace_id", "span_id"]
    known = nodes.select("trace_id", F.col("span_id").alias("_up"), F.lit(True).alias("_known"))
    state = written(nodes.withColumnRenamed("parent_span_id", "_up").join(known, ["trace_id", "_up"], "left").select(
        *keys, F.when(F.col("_known"), F.col("_up")).alias("_up"), F.when(F.col("_known"), 1).otherwise(0).alias("depth")))
    settled, waiting = state.where(F.col("_up").isNull()), state.where(F.col("_up").isNotNull())
    open_before, still_open = None, waiting.count()
    while still_open and still_open != open_before:
        reached = settled.unionByName(waiting).select(
            "trace_id", F.col("span_id").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_more"))
        state = written(waiting.join(reached, ["trace_id", "_up"], "left").select(
            *keys, F.col("_next").alias("_up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
        settled, waiting = settled.unionByName(state.where(F.col("_up").isNull())), state.where(F.col("_up").isNotNull())
        open_before, still_open = still_open, waiting.count()
    return settled.unionByName(waiting).select(*keys, F.when(F.col("_up").isNull(), F.col("depth")).alias("depth"))


def waterfall(agent: DataFrame, system: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Events of a trace (of all traces by default) with depth and start offset."""
    wanted = _has_trace(F.col("trace_id")) if trace_id is None else F.col("trace_id") == trace_id
    rows = event_layers(agent.where(wanted), system.where(wanted))
    # A log record shares the span of the operation that wrote it.
    nodes = rows.where(_has_trace(F.col("span_id"))).groupBy("trace_id", "span_id").agg(F.max("parent_span_id").alias("parent_span_id"))
    depths = span_depths(nodes)
    starts = rows.groupBy("trace_id").agg(F.min(F.unix_micros("ts")).alias("_start"))
    return rows.join(depths, ["trace_id", "span_id"], "left").join(starts, "trace_id").select(
        *rows.columns, "depth", (F.unix_micros("ts") - F.col("_start")).alias("offset_us"))


def spawn_edges(events: DataFrame) -> DataFrame:
    """Pairs of an event and the event it was spawned by."""
    children = events.where(F.col("spawned_by").isNotNull()).select(
        F.col("event_id").alias("child_id"), F.col("agent_id").alias("child_agent"), F.col("spawned_by").alias("parent_id"))
    parents = events.select(F.col("event_id").alias("parent_id"), F.col("agent_id").alias("parent_agent"))
    return children.join(parents, "parent_id").select("parent_id", "child_id", "parent_agent", "child_agent")
