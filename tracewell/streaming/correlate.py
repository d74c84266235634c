"""Continuous trace correlation and agent counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.rollups import merge_agents
from tracewell.operators.traces import correlate

CORRELATE_EVERY = "30 seconds"


def stream_correlate(system: DataFrame, agent: DataFrame, watermark: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Stream-stream form: system events joined with the agent events of their
    trace at most ``within`` apart; unmatched ones follow with a NULL session.

    A stream emits every candidate session, where the batch form takes the
    earliest; ``start_correlator`` gives the batch result.
    """
    s = system.drop("session_id").withWatermark("ts", watermark)
    a = agent.where(F.coalesce(F.col("trace_id") != "", F.lit(False))).select(
        F.col("trace_id").alias("a_trace"), F.col("ts").alias("a_ts"), "session_id").withWatermark("a_ts", watermark)
    near = F.expr(f"a_ts BETWEEN ts - INTERVAL {within} AND ts + INTERVAL {within}")
    return s.join(a, (F.col("trace_id") == F.col("a_trace")) & near, "leftOuter").drop("a_trace", "a_ts")


def start_correlator(system: DataFrame, agent_table: Callable[[], DataFrame], sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Link each micro-batch of system events against the agent events stored so far.

    Only agent events of the batch's own traces are shuffled.
    """
    def link(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        traces = batch.select("trace_id").distinct()
        linked = correlate(batch, agent_table().join(traces, "trace_id", "left_semi"))
        linked.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        batch.unpersist()

    return system.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"processingTime": CORRELATE_EVERY})).start()


def agent_delta(events: DataFrame) -> DataFrame:
    """Totals of a batch. Sessions are counted where they close, not here."""
    return events.groupBy("agent_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.lit(0).cast("bigint").alias("total_sessions"), F.count(F.lit(1)).alias("total_events"))


def start_agent_counters(events: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep agent totals current. Each batch writes version ``batch_id`` from the
    one before it, so a repeated batch gives the same version."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        delta = agent_delta(batch)
        if batch_id > 0:
            old = batch.sparkSession.read.parquet(f"{table}/version={batch_id - 1}")
            delta = merge_agents(old, delta)
        delta.write.mode("overwrite").parquet(f"{table}/version={batch_id}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"processingTime": CORRELATE_EVERY})).start()
