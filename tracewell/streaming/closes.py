"""Sessions of a stream that close by inactivity or by request, and the totals of their agents, all the time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.rollups import AGENT_COLUMNS, agent_totals, merge_agents
from tracewell.operators.sessions import DEFAULT_TIMEOUT, OWNER, merged_sessions
from tracewell.sources.versions import VersionedTable, rows_of

ACTIVITY = T.StructType([
    T.StructField("kind", T.StringType()), *[T.StructField(c, T.StringType()) for c in OWNER], T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.StringType()), T.StructField("context", T.StringType())])
#: What stays between batches: events and requests that are not final yet, open sessions, totals of agents over closed ones.
STATE = T.StructType([
    *ACTIVITY.fields, *[T.StructField(c, T.LongType()) for c in ("started", "last", "events", "sessions")],
    T.StructField("project_dir", T.StringType()), T.StructField("git_branch", T.StringType())])


def activity(events: DataFrame, closes: DataFrame | None = None) -> DataFrame:
    """Events and close requests (``agent_id, session_token, closed_at``) as one stream or table."""
    rows = events.select(F.lit("event").alias("kind"), *OWNER, "ts", "event_id", "context")
    if closes is None:
        return rows
    none = F.lit(None).cast("string")
    return rows.unionByName(closes.select(F.lit("close").alias("kind"), *OWNER, F.col("closed_at").alias("ts"),
                                          none.alias("event_id"), none.alias("context")))


class SessionCloser:
    """``foreachBatch`` function that emits each session once, when it is closed, and keeps the totals of agents.

    The watermark is the latest event time seen, less ``delay``. Rows before it
    are final: what a batch brings for earlier times is late and goes to the
    late table, with rows that lack an agent, a token or a time. Final rows are
    folded into sessions by the batch operator, open sessions carried along as
    pieces; a session is emitted when a request closes it, or when it has been
    idle at the watermark for longer than ``timeout``, with the ids, states and
    ends that ``session_rollup`` gives. A request closes nothing that begins
    after it. No key's events are gathered: an agent with a large share of
    them is spread over time slots as in the batch operator.

    State is a ``VersionedTable`` that a batch replaces in one commit after it
    has written its output folders, so a batch that is repeated, before or
    after its commit, changes nothing. It holds what is newer than the
    watermark, the open sessions, and a row per agent.
    """

    def __init__(self, spark: SparkSession, state: str, sessions: str, late: str,
                 timeout: timedelta = DEFAULT_TIMEOUT, delay: timedelta = timedelta(minutes=10)):
        self.state = VersionedTable(spark, state)
        self.sessions, self.late, self.timeout, self.delay = sessions, late, timeout, delay

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self.state.manifest()
        if before.info.get("batch", -1) >= batch_id:
            return
        low = before.info.get("watermark")
        rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in ACTIVITY]).persist()
        us = F.unix_micros("ts")
        whole = F.col("agent_id").isNotNull() & F.col("session_token").isNotNull() & F.col("ts").isNotNull()
        in_time = whole & (us >= low) if low is not None else whole
        latest = rows.where(in_time & (F.col("kind") == "event")).agg(F.max(us)).first()[0]
        high = max((x for x in (low, None if latest is None else latest - _micros(self.delay)) if x is not None), default=None)
        rows.where(~F.coalesce(in_time, F.lit(False))).withColumn("reason", F.when(whole, "late").otherwise("incomplete")) \
            .write.mode("overwrite").parquet(f"{self.late}/batch_id={batch_id}")

        held = rows_of(self.state, STATE, before)
        known = held.where(F.col("kind").isin("event", "close")).select(*ACTIVITY.names).unionByName(rows.where(in_time))
        final = F.lit(False) if high is None else us < high
        found = self._folded(known.where(final), held.where("kind = 'open'"))
        idle_at, limit = F.col("_last") + _micros(self.timeout), F.lit(high).cast("bigint")
        closed = found.withColumn("_completed", F.coalesce(F.col("_close") <= idle_at, F.lit(False))) \
            .withColumn("_over", F.col("_completed") | F.coalesce(idle_at < limit, F.lit(False))).persist()
        over = closed.where("_over").select(
            "session_id", *OWNER, F.when(F.col("_completed"), "completed").otherwise("timed_out").alias("status"),
            "_origin.project_dir", "_origin.git_branch", F.timestamp_micros("_started").alias("started_at"),
            F.timestamp_micros(F.when(F.col("_completed"), F.col("_close")).otherwise(idle_at)).alias("ended_at"),
            F.timestamp_micros("_last").alias("last_event_at"), "event_count")
        over.write.mode("overwrite").parquet(f"{self.sessions}/batch_id={batch_id}")
        written = self.state.spark.read.schema(over.schema).parquet(f"{self.sessions}/batch_id={batch_id}")
        totals = merge_agents(_totals_in(held), agent_totals(written))
        after = known.where(~final).unionByName(_open_rows(closed.where("NOT _over")), allowMissingColumns=True) \
            .unionByName(_total_rows(totals), allowMissingColumns=True)
        self.state.replace(before, after.select(*[F.col(f.name).cast(f.dataType) for f in STATE]), {"batch": batch_id, "watermark": high})
        self.state.vacuum(keep=2)
        closed.unpersist()
        rows.unpersist()

    def _folded(self, rows: DataFrame, opened: DataFrame) -> DataFrame:
        carried = opened.select(*OWNER, F.col("started").alias("_first"), F.col("last").alias("_last"), F.col("events").alias("_n"),
                                F.struct("project_dir", "git_branch").alias("_origin"))
        requests = rows.where("kind = 'close'").select(*OWNER, F.col("ts").alias("closed_at"))
        return merged_sessions(rows.where("kind = 'event'").drop("kind"), self.timeout, requests, carried)

    def agents(self) -> DataFrame:
        """Totals per agent of everything seen in time so far, sessions that are still open included."""
        held = rows_of(self.state, STATE)
        opened = self._folded(held.where(F.col("kind").isin("event", "close")).select(*ACTIVITY.names), held.where("kind = 'open'"))
        live = opened.select("agent_id", F.timestamp_micros("_started").alias("started_at"),
                             F.timestamp_micros("_last").alias("last_event_at"), "event_count")
        return merge_agents(_totals_in(held), agent_totals(live))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of ``activity`` rows."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint) \
            .trigger(**(trigger or {"processingTime": "1 minute"})).start()


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _totals_in(state: DataFrame) -> DataFrame:
    rows = state.where("kind = 'agent'")
    return rows.select("agent_id", F.timestamp_micros("started").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"),
                       F.col("sessions").alias("total_sessions"), F.col("events").alias("total_events")).select(*AGENT_COLUMNS)


def _total_rows(totals: DataFrame) -> DataFrame:
    return totals.select(F.lit("agent").alias("kind"), "agent_id", F.unix_micros("first_seen").alias("started"),
                         F.unix_micros("last_seen").alias("last"), F.col("total_sessions").alias("sessions"),
                         F.col("total_events").alias("events"))


def _open_rows(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.lit("open").alias("kind"), *OWNER, F.col("_started").alias("started"), F.col("_last").alias("last"),
                           F.col("event_count").alias("events"), "_origin.project_dir", "_origin.git_branch")
