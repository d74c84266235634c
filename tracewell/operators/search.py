"""Listing and searching events and sessions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordering import number_rows
from tracewell.operators.rollups import file_path, is_error, modifies_file


def _all(conditions: list[Column]) -> Column:
    result = F.lit(True)
    for c in conditions:
        result = result & c
    return result


def _contains_text(col: Column, text: str) -> Column:
    return F.lower(col).contains(text.lower())


def newest_first(df: DataFrame, limit: int | None = None, after: tuple[datetime | None, str] | None = None,
                 ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Newest rows first, rows without a time last, in the order of their ids.

    ``after`` is the ``(ts, id)`` of the last row already seen, ``(None, id)``
    among those without a time: a page costs a filter and a top-k, never a scan
    past earlier pages."""
    if after is not None:
        later_id = F.col(tie) > F.lit(after[1])
        if after[0] is None:
            df = df.where(F.col(ts).isNull() & later_id)
        else:
            at = F.lit(after[0]).cast("timestamp")
            df = df.where((F.col(ts) < at) | ((F.col(ts) == at) & later_id) | F.col(ts).isNull())
    ordered = df.orderBy(F.col(ts).desc(), F.col(tie))
    return ordered if limit is None else ordered.limit(limit)


def search_events(events: DataFrame, agent: str | None = None, session: str | None = None,
                  types: Sequence[str] | None = None, severities: Sequence[str] | None = None,
                  tools: Sequence[str] | None = None, tags: Sequence[str] | None = None, trace: str | None = None,
                  since: datetime | None = None, until: datetime | None = None, text: str | None = None,
                  limit: int | None = None, after: tuple[datetime | None, str] | None = None) -> DataFrame:
    """Agent events that meet every given condition; all ``tags`` must be present."""
    conditions = []
    for name, value in (("agent_id", agent), ("session_id", session), ("trace_id", trace)):
        if value is not None:
            conditions.append(F.col(name) == value)
    for name, values in (("event_type", types), ("severity", severities), ("tool_name", tools)):
        if values is not None:
            conditions.append(F.col(name).isin(list(values)))
    conditions += [F.array_contains("tags", t) for t in tags or ()]
    conditions += _time_range(since, until)
    if text is not None:
        conditions.append(_contains_text(F.col("message"), text))
    found = events.where(_all(conditions))
    return found if limit is None and after is None else newest_first(found, limit, after)


def _time_range(since: datetime | None, until: datetime | None) -> list[Column]:
    conditions = []
    if since is not None:
        conditions.append(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        conditions.append(F.col("ts") < F.lit(until).cast("timestamp"))
    return conditions


def list_system(system: DataFrame, services: Sequence[str] | None = None, severities: Sequence[str] | None = None,
                trace: str | None = None, session: str | None = None, text: str | None = None,
                since: datetime | None = None, until: datetime | None = None,
                limit: int | None = None, after: tuple[datetime | None, str] | None = None) -> DataFrame:
    conditions = _time_range(since, until)
    for name, values in (("source_service", services), ("severity", severities)):
        if values is not None:
            conditions.append(F.col(name).isin(list(values)))
    for name, value in (("trace_id", trace), ("session_id", session)):
        if value is not None:
            conditions.append(F.col(name) == value)
    if text is not None:
        conditions.append(_contains_text(F.coalesce(F.col("message"), F.col("event_name")), text))
    found = system.where(_all(conditions))
    return found if limit is None and after is None else newest_first(found, limit, after)


def list_sessions(sessions: DataFrame, agent: str | None = None, statuses: Sequence[str] | None = None,
                  project: str | None = None, since: datetime | None = None, limit: int | None = None,
                  after: tuple[datetime | None, str] | None = None) -> DataFrame:
    """Sessions that meet the filters, and pinned ones whatever the filters."""
    conditions = []
    if agent is not None:
        conditions.append(F.col("agent_id") == agent)
    if statuses is not None:
        conditions.append(F.col("status").isin(list(statuses)))
    if project is not None:
        conditions.append(F.col("project_dir") == project)
    if since is not None:
        conditions.append(F.col("started_at") >= F.lit(since).cast("timestamp"))
    found = sessions.where(F.coalesce(_all(conditions), F.lit(False)) | F.col("pinned"))
    if limit is None and after is None:
        return found
    return newest_first(found, limit, after, ts="started_at", tie="session_id")


def errors_with_context(events: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """Each error event with its neighbours in the session.

    ``position`` is relative to the error. Neighbours are found by an equal join
    on the row number, so the work grows with errors times window, not with
    their square. Events without a session are neighbours of each other.
    """
    # Rows are numbered on narrow columns: no payload travels through the sort.
    narrow = events.select("session_id", "event_id", "ts", "severity", "tool_name", "message")
    numbered = number_rows(narrow, ["session_id"], "ts", "event_id", "n")
    wanted = numbered.where(is_error()).select(
        "session_id", F.col("event_id").alias("error_id"), F.col("n").alias("_at"),
        F.explode(F.sequence(F.col("n") - before, F.col("n") + after)).alias("n"))
    w, n = wanted.alias("w"), numbered.alias("n")
    same = F.col("w.session_id").eqNullSafe(F.col("n.session_id")) & (F.col("w.n") == F.col("n.n"))
    return w.join(n, same).select(
        "n.session_id", "error_id", (F.col("n.n") - F.col("_at")).alias("position"), "event_id", "ts", "severity", "tool_name", "message")


def file_blame(events: DataFrame, history: bool = False) -> DataFrame:
    """Who last modified each file; with ``history`` every modification, newest as 1."""
    changes = events.where(modifies_file()).select(file_path().alias("path"), "agent_id", "session_id", "event_id", "ts")
    if history:
        totals = changes.groupBy("path").agg(F.count(F.lit(1)).alias("_total"))
        numbered = number_rows(changes, ["path"], "ts", "event_id", "_n", slice_seconds=3600)
        return numbered.join(totals, "path").select(*changes.columns, (F.col("_total") - F.col("_n") + 1).alias("recency"))
    last = F.max_by(F.struct("agent_id", "session_id", "event_id", "ts"), F.struct("ts", "event_id"))
    return changes.groupBy("path").agg(last.alias("last")).select("path", "last.*")


def timeline(events: DataFrame) -> DataFrame:
    """Events numbered in order within their session."""
    return number_rows(events, ["session_id"], "ts", "event_id", "seq")
