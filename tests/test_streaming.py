"""Streams against their batch twins."""

import json
import os
from datetime import timedelta

from pyspark.sql import functions as F

from tracewell.operators.rollups import agent_totals
from tracewell.operators.sessions import session_rollup, sessionize
from tracewell.operators.summaries import session_summary
from tracewell.plans import workload as w
from tracewell.sources.otlp import read_otlp_traces
from tracewell.streaming.correlate import start_agent_counters, stream_correlate
from tracewell.streaming.ingest import payload_stream, stream_otlp, stream_otlp_rejects
from tracewell.streaming.sessions import on_session_close, start_session_closer, stream_sessions

NOW = {"availableNow": True}
HALF_DAY = timedelta(hours=12)


def test_otlp_over_several_runs(spark, sf_dir, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    lines = w.trace_payloads(spark, sf_dir).select(F.col("body").alias("value"))
    for _ in range(2):
        lines.coalesce(1).write.mode("append").text(source)
        stream_otlp(payload_stream(spark, source), "trace", sink, checkpoint, **NOW).awaitTermination()
    stored = spark.read.parquet(sink)
    batch = read_otlp_traces(w.trace_payloads(spark, sf_dir)).events
    # Two files with the same lines are two deliveries; a restart adds nothing.
    assert stored.count() == 2 * batch.count() == stored.select("event_id").distinct().count()
    stream_otlp(payload_stream(spark, source), "trace", sink, checkpoint, **NOW).awaitTermination()
    assert spark.read.parquet(sink).count() == 2 * batch.count()


BODY = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"name": "a"}]}]}]})


def test_repeated_payloads_are_kept_unless_a_window_is_given(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(BODY,)] * 5, "value string").coalesce(1).write.text(source)
    for window, rows in ((None, 5), ("1 hour", 1)):
        sink, checkpoint = (str(tmp_path / f"{n}-{rows}") for n in ("out", "ck"))
        stream_otlp(payload_stream(spark, source), "trace", sink, checkpoint, window, **NOW).awaitTermination()
        assert spark.read.parquet(sink).count() == rows


def test_a_batch_writes_one_file_for_a_light_day(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(source)
    for i in range(4):  # every file has every day
        with open(f"{source}/{i}.txt", "w") as file:
            for day in range(5):
                span = {"name": f"{i}-{day}", "startTimeUnixNano": str((1 + day * 86_400) * 1_000_000_000)}
                file.write(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}) + "\n")
    stream_otlp(payload_stream(spark, source), "trace", sink, str(tmp_path / "ck"), **NOW).awaitTermination()
    stored = spark.read.parquet(sink)
    assert sorted((r.event_name, r.event_date.day) for r in stored.collect()) == [(f"{i}-{d}", d + 1) for i in range(4) for d in range(5)]
    assert len(stored.inputFiles()) == 5


def test_an_old_file_is_ingested_and_refused_payloads_are_kept(spark, tmp_path):
    source, sink, refused, ck = (str(tmp_path / n) for n in ("in", "out", "refused", "ck"))
    os.mkdir(source)
    for i, age in enumerate((0, 30_000, 90_000)):  # every file is older than the one before it
        path = f"{source}/{i}.txt"
        with open(path, "w") as file:
            file.write(BODY + "\n" + '{"resourceSpans": \n')
        os.utime(path, (1_700_000_000 - age,) * 2)
        stream_otlp(payload_stream(spark, source), "trace", sink, f"{ck}-a", **NOW).awaitTermination()
        stream_otlp_rejects(payload_stream(spark, source), "trace", refused, f"{ck}-b", **NOW).awaitTermination()
    assert spark.read.parquet(sink).count() == 3
    assert [r.reason for r in spark.read.parquet(refused).collect()] == ["malformed"] * 3


def test_events_can_go_to_a_function(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(BODY,)], "value string").write.text(source)

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    stream_otlp(payload_stream(spark, source), "trace", put, str(tmp_path / "ck"), **NOW).awaitTermination()
    assert spark.read.parquet(sink).count() == 1


def close_all(spark, sf_dir, tmp_path, summarize):
    sessions, summaries, retry, checkpoint = (str(tmp_path / n) for n in ("sessions", "summaries", "retry", "ck"))
    closed = stream_sessions(w.agent_events(spark, sf_dir, stream=True), HALF_DAY)
    handler = on_session_close(lambda: w.agent_events(spark, sf_dir), sessions, summaries, retry, summarize)
    start_session_closer(closed, handler, checkpoint, **NOW).awaitTermination()
    return sessions, summaries, retry


def test_closed_sessions_and_summaries(spark, sf_dir, tmp_path):
    sessions, summaries, _ = close_all(spark, sf_dir, tmp_path, session_summary)
    events = w.agent_events(spark, sf_dir)
    batch = session_rollup(events, w.as_of(), HALF_DAY).select("session_id", "started_at", "last_event_at", "event_count")
    streamed = spark.read.parquet(sessions).select(*batch.columns)
    assert streamed.count() > 500
    assert streamed.exceptAll(batch).isEmpty()
    # What is missing was still open when the stream ended.
    end = events.agg(F.max("ts")).first()[0]
    missing = batch.join(streamed, "session_id", "left_anti")
    assert missing.where(F.col("last_event_at") < F.lit(end) - F.expr("INTERVAL 12 HOURS 11 MINUTES")).isEmpty()
    expected = session_summary(sessionize(events, HALF_DAY)).join(streamed.select("session_id"), "session_id")
    stored = spark.read.parquet(summaries).select(*expected.columns)
    assert stored.count() == streamed.count() and stored.exceptAll(expected).isEmpty()


def test_failed_summary_does_not_block_the_close(spark, sf_dir, tmp_path):
    def broken(events):
        raise RuntimeError("no summary today")

    sessions, _, retry = close_all(spark, sf_dir, tmp_path, broken)
    closed, failed = spark.read.parquet(sessions), spark.read.parquet(retry)
    assert closed.count() == failed.count() > 500
    assert failed.first().error == "no summary today"


def test_counters_accumulate_over_batches(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "agents", "ck"))
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).select(
            F.concat(F.lit("a"), F.col("id") % 4).alias("agent_id"), F.timestamp_seconds("id").alias("ts")).coalesce(1) \
            .write.mode("append").parquet(source)
        stream = spark.readStream.schema("agent_id string, ts timestamp").parquet(source)
        start_agent_counters(stream, table, checkpoint, **NOW).awaitTermination()
    stored = spark.read.parquet(table)
    newest = stored.where(F.col("version") == stored.agg(F.max("version")).first()[0])
    assert {r.agent_id: (r.total_events, r.last_seen.second) for r in newest.collect()} == {
        "a0": (8, 28), "a1": (8, 29), "a2": (7, 26), "a3": (7, 27)}


def test_stream_stream_correlation(spark, sf_dir, tmp_path):
    """Every candidate session of the batch form's traces appears; unmatched rows come after the watermark."""
    source = str(tmp_path / "agent")
    sessionize(w.agent_events(spark, sf_dir), HALF_DAY).write.parquet(source)
    agent = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    linked = stream_correlate(w.system_events(spark, sf_dir, stream=True), agent, "1 minute", "100 days")
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    linked.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(**NOW).start().awaitTermination()
    got = spark.read.parquet(sink).where("session_id IS NOT NULL").select("event_id", "session_id")
    events = sessionize(w.agent_events(spark, sf_dir), HALF_DAY).select("trace_id", "session_id")
    expected = w.system_events(spark, sf_dir).drop("session_id").join(events, "trace_id").select("event_id", "session_id")
    assert got.count() == expected.count() > 0 and got.exceptAll(expected).isEmpty()


def test_agent_totals_equal_the_rollup(spark, sf_dir):
    events = w.agent_events(spark, sf_dir)
    totals = agent_totals(session_rollup(events, w.as_of(), HALF_DAY)).select("agent_id", "total_events")
    counted = events.groupBy("agent_id").agg(F.count("*").alias("total_events"))
    assert totals.exceptAll(counted).isEmpty() and totals.count() == counted.count()
