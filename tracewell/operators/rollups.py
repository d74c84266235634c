"""Rollups of agents, projects, tools and files.

Every one is a plain aggregation: rows are combined before the shuffle, so an
agent or session with a large share of all events costs one row per task.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import is_valid_agent_id

AGENT_COLUMNS = ("agent_id", "first_seen", "last_seen", "total_sessions", "total_events")


def valid_agents(df: DataFrame, col: str = "agent_id") -> tuple[DataFrame, DataFrame]:
    ok = is_valid_agent_id(F.col(col))
    return df.where(ok), df.where(~ok)


def agent_totals(sessions: DataFrame) -> DataFrame:
    """Lifetime totals per agent from the session rollup, which is far smaller
    than the events and already holds their counts and bounds."""
    return sessions.groupBy("agent_id").agg(
        F.min("started_at").alias("first_seen"), F.max("last_event_at").alias("last_seen"),
        F.count(F.lit(1)).alias("total_sessions"), F.sum("event_count").alias("total_events"))


def with_status(agents: DataFrame, as_of: Column, idle_after: timedelta = timedelta(minutes=30),
                offline_after: timedelta = timedelta(days=1)) -> DataFrame:
    """Add ``active``, ``idle`` or ``offline`` from the time since the last event."""
    quiet = F.unix_micros(as_of) - F.unix_micros("last_seen")
    micro = timedelta(microseconds=1)
    return agents.withColumn("status", F.when(quiet > offline_after // micro, "offline")
                             .when(quiet > idle_after // micro, "idle").otherwise("active"))


def agent_rollup(sessions: DataFrame, as_of: Column, **thresholds: timedelta) -> DataFrame:
    return with_status(agent_totals(sessions), as_of, **thresholds)


def new_agents(events: DataFrame, agents: DataFrame) -> DataFrame:
    """Agents with a valid id that are not registered yet, with first and last sight."""
    known = agents.select("agent_id")
    return valid_agents(events)[0].groupBy("agent_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("total_events"),
    ).join(known, "agent_id", "left_anti")


def merge_agents(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Registered agents plus the totals of a new batch: an upsert by aggregation."""
    return old.select(*AGENT_COLUMNS).unionByName(delta.select(*AGENT_COLUMNS)).groupBy("agent_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("total_sessions").alias("total_sessions"), F.sum("total_events").alias("total_events"))


OWNER_COLUMNS = ("agent_id", "session_token", "first_seen", "last_seen", "total_sessions", "total_events")


def owner_totals(sessions: DataFrame) -> DataFrame:
    """Totals per agent and token of a batch, with the ends that tell whether its first and last session go on elsewhere."""
    return sessions.groupBy("agent_id", "session_token").agg(
        F.min("started_at").alias("first_seen"), F.max("last_event_at").alias("last_seen"),
        F.count(F.lit(1)).alias("total_sessions"), F.sum("event_count").alias("total_events"))


def merge_owner_totals(totals: DataFrame, timeout: timedelta) -> DataFrame:
    """One row per agent and token from the ``owner_totals`` of batches that were cut by time, in any number and order.

    A session that a cut went through is in two batches, the gap between them
    no longer than ``timeout``; it counts once. What is merged can be merged
    again. What meets per agent and token is one row per batch.
    """
    order = Window.partitionBy("agent_id", "session_token").orderBy("first_seen", "last_seen")
    gap = F.unix_micros("first_seen") - F.unix_micros(F.lag("last_seen").over(order))
    goes_on = F.coalesce(gap <= timeout // timedelta(microseconds=1), F.lit(False)).cast("bigint")
    return totals.select(*OWNER_COLUMNS).withColumn("_goes_on", goes_on).groupBy("agent_id", "session_token").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        (F.sum("total_sessions") - F.sum("_goes_on")).alias("total_sessions"), F.sum("total_events").alias("total_events"))


def agents_of_owners(owners: DataFrame) -> DataFrame:
    """Totals per agent from those per agent and token."""
    return owners.groupBy("agent_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("total_sessions").alias("total_sessions"), F.sum("total_events").alias("total_events"))


def agent_project_activity(events: DataFrame) -> DataFrame:
    """Events, sessions and errors per agent and project."""
    project = F.get_json_object("context", "$.project_dir")
    per_session = events.groupBy("agent_id", project.alias("project_dir"), "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("errors"))
    return per_session.groupBy("agent_id", "project_dir").agg(
        F.sum("n").alias("events"), F.count("session_id").alias("sessions"), F.sum("errors").alias("errors"))


def is_error() -> Column:
    return F.col("severity").isin("error", "fatal")


def file_path() -> Column:
    """Path a tool call worked on, NULL when it names none."""
    return F.get_json_object("params", "$.file_path")


def modifies_file() -> Column:
    """Tools that change files are those named after editing or writing."""
    name = F.lower("tool_name")
    return F.coalesce(name.contains("edit") | name.contains("write"), F.lit(False)) & file_path().isNotNull()


def session_tools(events: DataFrame) -> DataFrame:
    return events.where(F.col("tool_name").isNotNull()).groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("calls"))


def session_files(events: DataFrame) -> DataFrame:
    """Files touched in each session, by any tool."""
    return events.select("session_id", "ts", file_path().alias("path")).where(F.col("path").isNotNull()) \
        .groupBy("session_id", "path").agg(
            F.count(F.lit(1)).alias("touches"), F.min("ts").alias("first_touch"), F.max("ts").alias("last_touch"))
