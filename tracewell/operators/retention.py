"""Retention of event tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources.sinks import days_of, utc_date
from tracewell.sources.versions import VersionedTable

DEFAULT_DAYS = 90


def apply_retention(df: DataFrame, as_of: Column, days: int = DEFAULT_DAYS) -> DataFrame:
    """Rows not older than ``days`` at ``as_of``, by event time.

    On a table partitioned by ``event_date`` older days are never read.
    """
    cutoff = as_of - F.make_dt_interval(days=F.lit(days))
    kept = df.where(F.col("ts") >= cutoff)
    return kept.where(F.col("event_date") >= utc_date(cutoff)) if "event_date" in df.columns else kept


def enforce_retention(table: VersionedTable, as_of: datetime, days: int = DEFAULT_DAYS) -> dict[str, int]:
    """Remove rows older than ``days`` at ``as_of`` (UTC where it has no zone) from a table partitioned by event date.

    Whole days leave the manifest without being read; of the day that the limit
    cuts, the rows that stay are written anew. Both happen in one commit, so
    that a reader sees the table before or after it. The files of the removed
    days go with ``table.vacuum``. Rows without a time stay. Returns the days
    dropped and the days rewritten; nothing is committed if both are 0.
    """
    at = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    limit = at.astimezone(timezone.utc) - timedelta(days=days)
    before = table.manifest()
    by_day, today = days_of(before), limit.date().isoformat()
    known = {d for d in by_day if not d.startswith("__")}
    dropped, cut = {d for d in known if d < today}, by_day.get(today, []) if limit.time() != datetime.min.time() else []
    if not dropped and not cut:
        return {"dropped": 0, "rewritten": 0}
    folders = [f for d, some in by_day.items() if d not in dropped and not (cut and d == today) for f in some]
    if cut:
        micros = (limit - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        folders += table.write(table.read(before, cut).where(F.unix_micros("ts") >= micros), "event_date")
    table.commit(before, folders, table.read(before).schema, before.info)
    return {"dropped": len(dropped), "rewritten": int(bool(cut))}
