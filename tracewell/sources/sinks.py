"""Writing event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracewell.sources.versions import Manifest, VersionedTable, partition_value


def utc_date(ts: Column) -> Column:
    """The UTC day of a time, whatever the session's zone: writers and readers must agree on partitions."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def count_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count the rows that pass, as a by-product of the action that reads them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def append_events(df: DataFrame, path: str) -> int:
    """Append to a parquet table partitioned by event date; rows written.

    The rebalance hint lets adaptive execution split a heavy day over several
    files and join light days into one, instead of one file per task and day.
    """
    dated = df.withColumn("event_date", utc_date(F.col("ts"))).hint("rebalance", "event_date")
    counted, seen = count_rows(dated, "append_events")
    counted.write.partitionBy("event_date").mode("append").parquet(path)
    return int(seen.get["rows"])


def append_once(df: DataFrame, table: VersionedTable, source: str, batch: int, unique: str | None = "event_id") -> dict[str, int]:
    """Append batch number ``batch`` of ``source`` to a table partitioned by event date, once; rows seen and inserted.

    The number of the last batch of every source is part of the commit, so a
    batch that is delivered again is passed over and gives the counts it had.
    With ``unique``, rows whose value there is stored already, or comes twice
    in the batch, are seen and not inserted; only the days of the batch are
    looked up. A job that fails before its commit leaves the table as it was.
    Rows without a time are kept under a NULL date.
    """
    before = table.manifest()
    done = before.info.get("sources", {}).get(source)
    if done is not None and batch <= done["batch"]:
        return {"seen": done["seen"], "inserted": done["inserted"]} if batch == done["batch"] else {"seen": 0, "inserted": 0}
    dated, arrived = count_rows(df.withColumn("event_date", utc_date(F.col("ts"))), "arrived")
    new = dated
    if unique is not None:
        new = new.dropDuplicates([unique])
        if before.folders:
            days = {str(r[0]) for r in df.select(utc_date(F.col("ts"))).distinct().collect()}  # one per day of the batch
            known = [f for f in before.folders if partition_value(f) in days or partition_value(f).startswith("__")]
            new = new.join(table.read(before, known).select(unique), unique, "left_anti").select(*dated.columns)
    stored, inserted = count_rows(new.hint("rebalance", "event_date"), "inserted")
    folders = table.write(stored, "event_date")
    counts = {"seen": int(arrived.get["rows"]), "inserted": int(inserted.get["rows"])}
    info = {**before.info, "sources": {**before.info.get("sources", {}), source: {"batch": batch, **counts}}}
    table.commit(before, before.folders + folders, dated.schema, info)
    return counts


def days_of(manifest: Manifest) -> dict[str, list[str]]:
    """The folders of a table partitioned by event date, by day; rows without a time have a day of their own."""
    days: dict[str, list[str]] = {}
    for folder in manifest.folders:
        days.setdefault(partition_value(folder), []).append(folder)
    return days
