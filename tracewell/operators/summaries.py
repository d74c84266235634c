"""Session summaries.

A summary has one header row per session and one row per list item (file, tool,
commit, error, timeline moment). ``summary_lists`` packs the items into arrays,
split into parts of a fixed length: a long session has more parts, none is cut
short and no task holds a whole session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordering import number_rows
from tracewell.operators.rollups import file_path, is_error, modifies_file


def session_summary(events: DataFrame) -> DataFrame:
    """Header: duration, event count and the length of each list."""
    modified = F.when(modifies_file(), file_path())
    us = F.unix_micros("ts")
    # Distinct tools and files are counted on rows already combined per tool and file.
    combined = events.groupBy("session_id", "agent_id", "tool_name", modified.alias("path")).agg(
        F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "git_commit").alias("commits"), F.count_if(is_error()).alias("errors"))
    seconds = F.floor((F.max("last_us") - F.min("first_us")) / 1_000_000)
    return combined.groupBy("session_id", "agent_id").agg(
        seconds.alias("duration_seconds"), F.sum("n").alias("event_count"),
        F.count_distinct("path").alias("files_modified"), F.count_distinct("tool_name").alias("tools_used"),
        F.sum("commits").alias("commits"), F.sum("errors").alias("errors"))


def summary_items(events: DataFrame) -> DataFrame:
    """All list items: ``session_id, kind, pos, ts, item, label, n``."""
    def entry(kind: str, item: Column, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"), label.alias("label"))

    commit, modified, tool = F.col("event_type") == "git_commit", modifies_file(), F.col("tool_name")
    event, path = (F.col("event_id"), F.col("message")), (file_path(), file_path())
    entries = F.array_compact(F.array(
        F.when(tool.isNotNull(), entry("tool", tool, tool)), F.when(modified, entry("file", *path)),
        F.when(commit, entry("commit", *event)), F.when(is_error(), entry("error", *event)),
        F.when(commit | is_error() | modified, entry("moment", *event))))
    # One pass: tools and files combine per session, events stay as they are.
    listed = events.select("session_id", "ts", F.explode(entries).alias("e"))
    combined = listed.groupBy("session_id", "e.kind", "e.item", "e.label").agg(
        F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    return number_rows(combined, ["session_id", "kind"], "ts", "item", "pos")


def summary_lists(items: DataFrame, part_size: int = 1000) -> DataFrame:
    """Items as JSON arrays, ``part_size`` to a part, in order."""
    part = F.floor((F.col("pos") - 1) / part_size)
    entry = F.struct("pos", F.unix_micros("ts").alias("us"), "item", "label", "n")
    return items.groupBy("session_id", "kind", part.alias("part")).agg(
        F.to_json(F.array_sort(F.collect_list(entry))).alias("items"))


def session_detail(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sessions with their summary, if one exists."""
    extra = [c for c in summaries.columns if c not in sessions.columns]
    return sessions.join(summaries.select("session_id", *extra), "session_id", "left")
