"""Continuous ingest of OTLP payloads and embedding of new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tracewell.operators.embedding import Backend, embed
from tracewell.sources.otlp import read_otlp_logs, read_otlp_traces
from tracewell.sources.payloads import Decoded
from tracewell.sources.sinks import utc_date


Sink = str | Callable[[DataFrame, int], None]


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """Text files with one payload per line, as a stream.

    The id and the ingest time come from the file, so a replayed batch gives the
    same rows. Equal lines of one file are all kept; they share their ids.
    """
    lines = spark.readStream.format("text").load(path)
    return lines.select(
        F.sha2(F.concat_ws("|", "_metadata.file_path", "value"), 256).alias("payload_id"),
        F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("ingested_at"))


def decode_stream(payloads: DataFrame, signal: str, replay_window: str | None = None) -> Decoded:
    """Decoded stream. The file source delivers every file once whatever its age, so nothing is dropped by default.

    With a ``replay_window``, for sources that may deliver twice, a payload id
    seen again within it is dropped, and so are payloads that are later than it.
    """
    if replay_window is not None:
        payloads = payloads.withWatermark("ingested_at", replay_window).dropDuplicatesWithinWatermark(["payload_id"])
    return read_otlp_traces(payloads) if signal == "trace" else read_otlp_logs(payloads)


def to_files(stream: DataFrame, sink: str, checkpoint: str, partition_by: str | None = None) -> DataStreamWriter:
    writer = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return writer if partition_by is None else writer.partitionBy(partition_by)


def to_sink(stream: DataFrame, sink: Sink, checkpoint: str, partition_by: str | None = None) -> DataStreamWriter:
    """A folder is written exactly once; a function gets (batch, batch id) and may see a batch again after a failure."""
    if callable(sink):
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return to_files(stream, sink, checkpoint, partition_by)


def stream_otlp(payloads: DataFrame, signal: str, sink: Sink, checkpoint: str,
                replay_window: str | None = None, **trigger) -> StreamingQuery:
    """Write the events of a payload stream to a table divided by UTC day, or hand them to a function.

    The rebalance hint lets adaptive execution split a heavy day of a batch over
    several files and join light days, instead of one file per task and day. A
    ``replay_window`` keeps state, which turns adaptive execution off; a heavy
    day would be one task's then, so such a stream stays as it is dealt.
    """
    events = decode_stream(payloads, signal, replay_window).events.withColumn("event_date", utc_date(F.col("ts")))
    if replay_window is None and not callable(sink):
        events = events.hint("rebalance", "event_date")
    return to_sink(events, sink, checkpoint, "event_date").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def stream_otlp_rejects(payloads: DataFrame, signal: str, sink: Sink, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the refused payloads of a stream, with their reasons; a query of its own beside ``stream_otlp``."""
    return to_sink(decode_stream(payloads, signal).rejects, sink, checkpoint).trigger(
        **(trigger or {"processingTime": "10 seconds"})).start()


def stream_embed(rows: DataFrame, text_col: str, load: Callable[[], Backend], dims: int, sink: str, checkpoint: str,
                 **trigger) -> StreamingQuery:
    """Embed new rows, such as closed sessions, as they arrive."""
    embedded = embed(rows, text_col, load, dims)
    return to_files(embedded, sink, checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
