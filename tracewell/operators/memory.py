"""Agent memory: a key-value view over an append-only change log.

Puts and deletes are rows ``agent_id, key, value, tags, shared, op, ts, seq``;
``seq`` orders rows of the same instant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources.versions import VersionedTable

KEY = ["agent_id", "key"]


def memory_view(log: DataFrame) -> DataFrame:
    """Live entries: the latest put of each key that no delete follows.

    ``created_at`` is the first put since the last delete. Both passes combine
    before the shuffle, so a key written without end is one row per task; the
    second runs only over keys that were deleted and written again.
    """
    at = F.struct("ts", "seq")
    payload = [c for c in log.columns if c not in (*KEY, "op", "ts", "seq")]
    is_delete = F.col("op") == "delete"
    latest = log.groupBy(*KEY).agg(
        F.max_by(F.struct("op", "ts", *payload), at).alias("_last"),
        F.max(F.when(is_delete, at)).alias("_deleted"), F.min("ts").alias("_first"),
    ).where(F.col("_last.op") != "delete")
    revived = latest.where(F.col("_deleted").isNotNull()).select(*KEY, "_deleted")
    again = log.where(~is_delete).select(*KEY, "ts", "seq").join(revived, KEY) \
        .where(at > F.col("_deleted")).groupBy(*KEY).agg(F.min("ts").alias("_again"))
    return latest.join(again, KEY, "left").select(
        *KEY, *[F.col(f"_last.{c}").alias(c) for c in payload],
        F.coalesce("_again", "_first").alias("created_at"), F.col("_last.ts").alias("updated_at"))


def visible(memory: DataFrame, agent: str | Column) -> DataFrame:
    """An agent's own entries, and those of others that are shared."""
    return memory.where((F.col("agent_id") == agent) | F.col("shared"))


def list_memory(memory: DataFrame, agent: str, tags: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    found = visible(memory, agent)
    for tag in tags or ():
        found = found.where(F.array_contains("tags", tag))
    # a key is unique only with its agent
    return found if limit is None else found.orderBy(F.col("updated_at").desc(), "key", "agent_id").limit(limit)


def compact_log(log: DataFrame) -> DataFrame:
    """The rows of a change log that later rows can still meet.

    For every key its last row, its last delete, and the first put since then,
    which dates the entry. ``memory_view`` of these rows and any later ones is
    that of the whole log and the later ones, puts that arrive out of order
    included; only a delete that is older than a row it is compacted with may
    find that row gone.
    """
    at = F.struct("ts", "seq")
    row = F.struct(*[c for c in log.columns if c not in KEY])
    is_delete = F.col("op") == "delete"
    marks = log.groupBy(*KEY).agg(F.max_by(row, at).alias("_last"), F.max_by(row, F.when(is_delete, at)).alias("_deleted"))
    since = F.col("_deleted").isNull() | (at > F.struct("_deleted.ts", "_deleted.seq"))
    firsts = log.where(~is_delete).join(marks.select(*KEY, "_deleted"), KEY).where(since).groupBy(*KEY).agg(F.min_by(row, at).alias("_first"))
    kept = F.array_distinct(F.filter(F.array("_last", "_deleted", "_first"), lambda r: r.isNotNull()))
    rows = marks.join(firsts, KEY, "left").select(*KEY, F.explode(kept).alias("_row"))
    return rows.select(*[F.col(c) if c in KEY else F.col(f"_row.{c}") for c in log.columns])


class MemoryLog:
    """A change log kept as a snapshot and a tail of batches under one manifest.

    ``append`` adds to the tail, ``compact`` turns snapshot and tail into a new
    snapshot; a reader sees the log before or after either, never in between.
    """

    def __init__(self, table: VersionedTable):
        self.table = table

    def append(self, changes: DataFrame) -> None:
        before = self.table.manifest()
        self.table.commit(before, before.folders + self.table.write(changes), changes.schema, before.info)

    def compact(self) -> None:
        before = self.table.manifest()
        if len(before.folders) > 1:
            self.table.replace(before, compact_log(self.table.read(before)), before.info)

    def view(self) -> DataFrame:
        """The live entries."""
        return memory_view(self.table.read())
