"""Sessions closed by inactivity, as a stream, and what follows a close."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.sessions import DEFAULT_TIMEOUT, OWNER, attach_sessions, session_id
from tracewell.operators.summaries import session_summary
from tracewell.sources.sinks import utc_date


def _interval(span: timedelta) -> str:
    return f"{span // timedelta(microseconds=1)} microseconds"


def stream_sessions(events: DataFrame, timeout: timedelta = DEFAULT_TIMEOUT, watermark: str = "10 minutes") -> DataFrame:
    """Sessions of an event stream, each emitted once, when the watermark closes it.

    The same ids as the batch operator gives. Sessions still open stay in state.
    For agents with a large share of the events set the session's
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``,
    so that they send one row per task; an operator does not change settings.
    """
    us = F.unix_micros("ts")
    windows = events.select("event_id", *OWNER, "ts").withWatermark("ts", watermark) \
        .groupBy(*OWNER, F.session_window("ts", _interval(timeout))) \
        .agg(F.min(us).alias("_first"), F.max(us).alias("_last"), F.count(F.lit(1)).alias("event_count"))
    return windows.select(
        session_id(F.col("agent_id"), F.col("session_token"), F.col("_first")).alias("session_id"), *OWNER,
        F.timestamp_micros("_first").alias("started_at"), F.timestamp_micros("_last").alias("last_event_at"),
        F.col("session_window.end").alias("ended_at"), "event_count")


def _events_of(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stored events of some sessions; only the days these span are read."""
    low, high = sessions.agg(F.min("started_at"), F.max("last_event_at")).first()
    recent = events.where(F.col("ts").between(F.lit(low), F.lit(high)))
    if "event_date" in events.columns:
        recent = recent.where(F.col("event_date").between(utc_date(F.lit(low)), utc_date(F.lit(high))))
    return attach_sessions(recent, sessions).where(F.col("session_id").isNotNull())


def on_session_close(stored_events: Callable[[], DataFrame], sessions_path: str, summaries_path: str, retry_path: str,
                     summarize: Callable[[DataFrame], DataFrame] | None = session_summary) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for closed sessions.

    The close is stored first; the summary follows and may fail without undoing
    it, in which case the sessions go to the retry table. A batch overwrites its
    own folder, so a repeated batch changes nothing.
    """
    def handle(closed: DataFrame, batch_id: int) -> None:
        spark = closed.sparkSession
        folder = f"batch_id={batch_id}"
        closed.write.mode("overwrite").parquet(f"{sessions_path}/{folder}")
        if summarize is None:
            return
        stored = spark.read.parquet(f"{sessions_path}/{folder}")
        if stored.isEmpty():
            return
        try:
            summarize(_events_of(stored_events(), stored)).write.mode("overwrite").parquet(f"{summaries_path}/{folder}")
        except Exception as error:  # a summary failure must never block the close
            _dead_letters(stored, error, 1).write.mode("overwrite").parquet(f"{retry_path}/{folder}")

    return handle


def _dead_letters(sessions: DataFrame, error: Exception, attempts: int) -> DataFrame:
    return sessions.select("session_id", F.lit(str(error)).alias("error"), F.lit(attempts).alias("attempts"))


def retry_summaries(spark: SparkSession, stored_events: Callable[[], DataFrame], sessions_path: str, summaries_path: str, retry_path: str,
                    summarize: Callable[[DataFrame], DataFrame] = session_summary, most: int = 5) -> dict[str, int]:
    """Summarise the batches in the retry table again; batches done, failed again, and given up.

    A batch that succeeds writes the summary folder that its close would have
    written, whole, and only then leaves the retry table: run twice, or ended
    between the two, it gives each summary once. One that fails stays with its
    last error and one attempt more, until it has had ``most``; then it stays
    and is passed over.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(retry_path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = sorted(s.getPath().getName() for s in files.listStatus(root)) if files.exists(root) else []
    outcome = {"done": 0, "failed": 0, "given_up": 0}
    for folder in (f for f in folders if f.startswith("batch_id=")):
        attempts = spark.read.parquet(f"{retry_path}/{folder}").agg(F.max("attempts")).first()[0]
        if attempts >= most:
            outcome["given_up"] += 1
            continue
        stored = spark.read.parquet(f"{sessions_path}/{folder}")
        try:
            summarize(_events_of(stored_events(), stored)).write.mode("overwrite").parquet(f"{summaries_path}/{folder}")
        except Exception as error:
            _dead_letters(stored, error, attempts + 1).write.mode("overwrite").parquet(f"{retry_path}/{folder}")
            outcome["failed"] += 1
        else:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{retry_path}/{folder}"), True)
            outcome["done"] += 1
    return outcome


def start_session_closer(sessions: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    return sessions.writeStream.foreachBatch(handler).outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
