"""Continuous trace correlation that takes back what it said: system events are linked again when agent events arrive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.traces import correlate
from tracewell.sources.versions import VersionedTable, rows_of

#: System events of traces that may still change, with the session told last.
WAITING = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("trace_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("session_id", T.StringType())])
KEEP = timedelta(hours=24)


class TraceLinker:
    """``foreachBatch`` function over rows ``kind`` ('system' or 'agent'), ``event_id, trace_id, ts``.

    A system event is told at once, with the session of its trace or NULL. It
    then waits for ``keep`` of event time; when a batch brings agent events of
    its trace and the earliest of these gives another session, it is told
    again as an update. Only traces that a batch names are looked up and
    joined. ``agent_table`` gives the agent events stored so far with
    ``trace_id, ts, event_id, session_id``; their batch must be stored before
    it comes here. Rows of the sink have ``batch_id`` and ``update``;
    ``linked`` gives the last word on every event. Output folders are
    overwritten and the waiting events replaced in one commit, so a repeated
    batch changes nothing. Events without a trace are told once and do not wait.
    """

    def __init__(self, spark: SparkSession, state: str, sink: str, agent_table: Callable[[], DataFrame], keep: timedelta = KEEP):
        self.state, self.sink, self.agent_table, self.keep = VersionedTable(spark, state), sink, agent_table, keep

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self.state.manifest()
        if before.info.get("batch", -1) >= batch_id:
            return
        batch = batch.select("kind", *[F.col(f.name).cast(f.dataType) for f in WAITING if f.name != "session_id"]).persist()
        traced = F.coalesce(F.col("trace_id") != "", F.lit(False))
        named = batch.where(traced).select("trace_id").distinct().persist()
        held = rows_of(self.state, WAITING, before)
        told = held.withColumn("update", F.lit(True)).join(named, "trace_id", "left_semi").select(*WAITING.names, "update")
        new = batch.where("kind = 'system'").select("event_id", "trace_id", "ts", F.lit(None).cast("string").alias("session_id"),
                                                    F.lit(False).alias("update"))
        candidates = told.unionByName(new).withColumnRenamed("session_id", "told").withColumn("session_id", F.lit(None).cast("string"))
        linked = correlate(candidates, self.agent_table().join(named, "trace_id", "left_semi")).persist()
        changed = linked.where(~F.col("update") | ~F.col("told").eqNullSafe(F.col("session_id")))
        changed.select(*WAITING.names, "update").write.mode("overwrite").parquet(f"{self.sink}/batch_id={batch_id}")

        latest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
        latest = max((x for x in (before.info.get("latest"), latest) if x is not None), default=None)
        waiting = held.join(named, "trace_id", "left_anti").select(*WAITING.names).unionByName(linked.where(traced).select(*WAITING.names))
        if latest is not None:
            waiting = waiting.where(F.unix_micros("ts") >= latest - self.keep // timedelta(microseconds=1))
        self.state.replace(before, waiting, {"batch": batch_id, "latest": latest})
        self.state.vacuum(keep=2)
        for df in (linked, named, batch):
            df.unpersist()

    def linked(self) -> DataFrame:
        """The session told last for every system event."""
        rows = self.state.spark.read.schema(T.StructType([*WAITING.fields, T.StructField("update", T.BooleanType()),
                                                          T.StructField("batch_id", T.LongType())])).parquet(self.sink)
        last = F.max_by(F.struct("trace_id", "ts", "session_id"), "batch_id").alias("_last")
        return rows.groupBy("event_id").agg(last).select("event_id", "_last.*")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of system and agent rows."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint) \
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start()
