"""The registered queries: every operator over whole tables.

Timestamps are returned as epoch microseconds, so that results compare equal
whatever the reader does with time zones.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.redaction import redact_json
from tracewell.functions.scalars import default_agent_id, is_valid_agent_id, log_severity, mask_secret, mask_url
from tracewell.functions.vectors import cosine, noop_vector
from tracewell.operators.checkpoints import work_dir
from tracewell.operators.edges import (
    caused_by, enrich_calls, followed_by, owns, span_edges, spawned_sessions, tool_patterns, touched,
)
from tracewell.operators.embedding import check_dims, embed, embed_once
from tracewell.operators.memory import MemoryLog, list_memory, memory_view, visible
from tracewell.operators.ranked_text import RankedIndex
from tracewell.operators.retention import apply_retention, enforce_retention
from tracewell.operators.retrieval import both_ways, hybrid_search
from tracewell.operators.rollups import (
    agent_project_activity, agent_rollup, agent_totals, agents_of_owners, merge_agents, merge_owner_totals, new_agents, owner_totals,
    session_files, session_tools,
)
from tracewell.operators.search import (
    errors_with_context, file_blame, list_sessions, list_system, search_events, timeline,
)
from tracewell.operators.sessions import attach_sessions, idle_sessions, session_ordinal, session_rollup, sessionize
from tracewell.operators.similarity import memory_id, memory_search, recall
from tracewell.operators.summaries import session_detail, session_summary, summary_items, summary_lists
from tracewell.operators.text_index import build_text_index, search_text_index, text_search, write_text_index
from tracewell.operators.traces import correlate, event_layers, spawn_edges, waterfall
from tracewell.operators.vector_index import VectorIndex
from tracewell.plans import workload as w
from tracewell.sources.agent_events import read_agent_events
from tracewell.sources.hooks import read_hook_events
from tracewell.sources.otlp import read_otlp_logs, read_otlp_traces
from tracewell.sources.sinks import append_events, append_once
from tracewell.sources.versions import VersionedTable
from tracewell.streaming.closes import SessionCloser, activity
from tracewell.streaming.correlate import start_agent_counters, start_correlator
from tracewell.streaming.ingest import payload_stream, stream_embed, stream_otlp, stream_otlp_rejects
from tracewell.streaming.relink import TraceLinker
from tracewell.streaming.sessions import on_session_close, start_session_closer, stream_sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HALF_DAY = timedelta(hours=12)
TEXT_QUERY = "The, and!"
RANKED_QUERY = "The and of"
PHRASE_QUERY = "of the"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def us(col: str) -> Column:
    """A timestamp column as epoch microseconds, named ``<col>_us``."""
    return F.unix_micros(col).alias(f"{col.split('.')[-1]}_us")


SYSTEM_COLUMNS = ("event_id", "trace_id", "span_id", "parent_span_id", "source_type", "signal", "source_service", "severity",
                  "event_name", "message", "attributes", "resource", "duration_ms")


def _system_rows(df: DataFrame) -> DataFrame:
    return df.select(*SYSTEM_COLUMNS, us("ts"))


@query
def otlp_traces(spark, sf):
    return _system_rows(read_otlp_traces(w.trace_payloads(spark, sf)).events)


@query
def otlp_service_stats(spark, sf):
    """Spans and mean duration per service and severity, straight from the payloads."""
    return read_otlp_traces(w.trace_payloads(spark, sf)).events.groupBy("source_service", "severity").agg(
        F.count(F.lit(1)).alias("spans"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"))


@query
def otlp_logs(spark, sf):
    return _system_rows(read_otlp_logs(w.log_payloads(spark, sf)).events)


@query
def otlp_rejects(spark, sf):
    traces = read_otlp_traces(w.trace_payloads(spark, sf)).rejects.select(F.lit("trace").alias("signal"), "payload_id", "reason")
    logs = read_otlp_logs(w.log_payloads(spark, sf)).rejects.select(F.lit("log").alias("signal"), "payload_id", "reason")
    return traces.unionByName(logs)


def _hook_events(spark, sf):
    given = F.when(F.col("agent_id").endswith("7"), "").otherwise(F.col("agent_id"))
    return read_hook_events(w.hook_payloads(spark, sf), default_agent_id(given, F.lit("build1")))


@query
def hook_events(spark, sf):
    return _hook_events(spark, sf).events.select(
        "event_id", "agent_id", "session_token", us("ts"), "event_type", "severity", "tool_name", "tool_type", "message",
        "params", "result", "context", "duration_ms")


@query
def hook_rejects(spark, sf):
    return _hook_events(spark, sf).rejects.select("payload_id", "reason")


@query
def event_batches(spark, sf):
    return read_agent_events(w.event_batches(spark, sf)).events.select(
        "event_id", "agent_id", "session_token", us("ts"), "event_type", "severity", "tool_name", "message", "duration_ms",
        F.array_join("tags", ",").alias("tags"), "trace_id", "span_id")


@query
def append_by_day(spark, sf):
    """Append both kinds of system events to a partitioned table and read it back."""
    path = f"{work_dir(spark)}/system_events"
    written = append_events(w.system_events(spark, sf), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("events")).withColumn("written", F.lit(written).cast("bigint"))


@query
def redact_params(spark, sf):
    return redact_json(w.spread(w.agent_events(spark, sf)), ["params", "result"]).select("event_id", "params", "result")


@query
def severity_map(spark, sf):
    number = (F.floor(F.col("value") / 10) - 1).alias("severity_number")
    counted = w.events(spark, sf).groupBy(number).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("severity_number", log_severity(F.col("severity_number")).alias("severity"), "n")


@query
def agent_id_valid(spark, sf):
    c = w.table(spark, sf, "customer")
    name = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.col("c_name")).otherwise(F.translate("c_name", "#", "-"))
    return c.select("c_custkey", is_valid_agent_id(name).alias("valid"))


@query
def mask_urls(spark, sf):
    login = F.concat(F.lit("://user:pw"), F.col("page_id").cast("string"), F.lit("@"))
    url = F.replace(F.col("url"), F.lit("://"), login)
    return w.table(spark, sf, "pages").select("page_id", mask_url(url).alias("url"), mask_secret(F.col("html")).alias("html"))


def _sessionized(spark, sf, timeout=HALF_DAY, closes=None):
    return sessionize(w.agent_events(spark, sf), timeout, closes)


def _sessions(spark, sf, timeout=HALF_DAY, **more):
    return session_rollup(w.agent_events(spark, sf), w.as_of(), timeout, **more)


def _session_rows(df):
    return df.select("session_id", "session_token", "agent_id", "session_seq", "status", "project_dir", "git_branch",
                     us("started_at"), us("ended_at"), us("last_event_at"), "event_count")


def _commit_closes(spark, sf):
    """Every commit closes its session."""
    e = w.agent_events(spark, sf).where(F.col("event_type") == "git_commit")
    return e.select("agent_id", "session_token", F.col("ts").alias("closed_at"))


@query
def sessionize_30m(spark, sf):
    return _sessionized(spark, sf, timedelta(minutes=30)).select("event_id", "session_id", "session_seq", us("session_started_at"))


@query
def sessionize_12h(spark, sf):
    return _sessionized(spark, sf).select("event_id", "session_id", "session_seq", us("session_started_at"))


@query
def sessionize_closes(spark, sf):
    return _sessionized(spark, sf, HALF_DAY, _commit_closes(spark, sf)).select(
        "event_id", "session_id", "session_seq", us("session_started_at"))


@query
def session_rollup_12h(spark, sf):
    return _session_rows(_sessions(spark, sf))


@query
def session_rollup_closes(spark, sf):
    return _session_rows(_sessions(spark, sf, closes=_commit_closes(spark, sf)))


@query
def session_attach(spark, sf):
    return attach_sessions(w.agent_events(spark, sf), _sessions(spark, sf)).select("event_id", "session_id")


@query
def session_ordinals(spark, sf):
    return session_ordinal(_sessions(spark, sf)).select("session_id", "agent_id", "ordinal")


@query
def idle_session_list(spark, sf):
    """Sessions still open under a 12 h timeout that have been quiet for 30 min."""
    return idle_sessions(_sessions(spark, sf), w.as_of()).select("session_id", us("last_event_at"))


@query
def session_list_pinned(spark, sf):
    """Active sessions of one project, and all pinned ones: those opened by a commit."""
    first = _sessionized(spark, sf).where((F.col("event_type") == "git_commit") & (F.col("ts") == F.col("session_started_at")))
    sessions = _sessions(spark, sf, pins=first.select("session_id"))
    return list_sessions(sessions, statuses=["active"], project="/work/p1").select("session_id", "status", "pinned")


@query
def agent_rollup_all(spark, sf):
    rolled = agent_rollup(_sessions(spark, sf), w.as_of(), idle_after=timedelta(hours=2), offline_after=timedelta(hours=12))
    return rolled.select("agent_id", us("first_seen"), us("last_seen"), "total_sessions", "total_events", "status")


@query
def agents_new(spark, sf):
    """Agents of the events that are not registered; household customers stand for the registered ones."""
    known = w.table(spark, sf, "customer").where(F.col("c_mktsegment") == "HOUSEHOLD").select(
        F.concat(F.lit("agent-"), F.col("c_custkey").cast("string")).alias("agent_id"))
    return new_agents(w.agent_events(spark, sf), known).select("agent_id", us("first_seen"), us("last_seen"), "total_events")


@query
def agents_merged(spark, sf):
    """Totals of two batches of sessions, merged: equal to those of all sessions."""
    sessions = _sessions(spark, sf)
    early = F.col("session_token") == "tok-0"
    merged = merge_agents(agent_totals(sessions.where(early)), agent_totals(sessions.where(~early)))
    return merged.select("agent_id", us("first_seen"), us("last_seen"), "total_sessions", "total_events")


@query
def project_activity(spark, sf):
    return agent_project_activity(_sessionized(spark, sf))


@query
def session_summaries(spark, sf):
    return session_summary(_sessionized(spark, sf))


@query
def session_summary_items(spark, sf):
    return summary_items(_sessionized(spark, sf)).select("session_id", "kind", "pos", us("ts"), "item", "label", "n")


@query
def session_summary_lists(spark, sf):
    return summary_lists(summary_items(_sessionized(spark, sf)), part_size=4)


@query
def session_details(spark, sf):
    e = _sessionized(spark, sf)
    detail = session_detail(_sessions(spark, sf), session_summary(e.where(F.col("session_token") == "tok-0")))
    return detail.select("session_id", "status", "event_count", "duration_seconds", "files_modified", "commits", "errors")


@query
def session_tool_counts(spark, sf):
    return session_tools(_sessionized(spark, sf))


@query
def session_file_touches(spark, sf):
    return session_files(_sessionized(spark, sf)).select("session_id", "path", "touches", us("first_touch"), us("last_touch"))


@query
def session_timeline(spark, sf):
    return timeline(_sessionized(spark, sf)).select("session_id", "seq", "event_id")


@query
def chat_timeline(spark, sf):
    return timeline(w.chat_events(spark, sf)).select("session_id", "seq", "event_id", F.length("message").alias("chars"))


def _at(day: int) -> datetime:
    return datetime(2024, 1, day, tzinfo=timezone.utc)


@query
def log_search(spark, sf):
    found = search_events(w.agent_events(spark, sf), types=["error", "tool_call"], severities=["error", "warn"], tools=["Bash"],
                          tags=["k3"], since=_at(5), until=_at(25), text="COMMAND")
    return found.select("event_id", "agent_id", us("ts"), "severity", "message")


@query
def log_search_newest(spark, sf):
    """Second page of the newest errors."""
    found = search_events(w.agent_events(spark, sf), severities=["error"], limit=50, after=(_at(20), ""))
    return found.select("event_id", us("ts"))


@query
def chat_search(spark, sf):
    return search_events(w.chat_events(spark, sf), tags=["user"], text="the").select("event_id", "session_id", us("ts"))


@query
def system_list(spark, sf):
    found = list_system(w.system_events(spark, sf), services=["svc-1", "unknown"], severities=["error"], text="urgent")
    return found.select("event_id", us("ts"), "source_service", "event_name", "duration_ms")


@query
def text_search_scan(spark, sf):
    return text_search(w.table(spark, sf, "documents"), "doc_id", "text", TEXT_QUERY)


@query
def text_search_index(spark, sf):
    """From a stored index that was written twice, as after a repeated job."""
    path = work_dir(spark)
    for _ in range(2):
        write_text_index(build_text_index(w.table(spark, sf, "documents"), "doc_id", "text"), path)
    return search_text_index(spark.read.parquet(path), "doc_id", TEXT_QUERY)


def _ranked_index(spark, sf):
    """The documents in two segments, one of them delivered twice, merged."""
    index = RankedIndex(spark, work_dir(spark))
    docs = w.table(spark, sf, "documents")
    for part in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 0"), docs):
        index.add(part, "doc_id", "text")
    index.merge()
    return index


@query
def text_search_ranked(spark, sf):
    return _ranked_index(spark, sf).search(RANKED_QUERY, 100).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query
def text_search_phrase(spark, sf):
    return _ranked_index(spark, sf).phrase(PHRASE_QUERY).select(F.col("id").alias("doc_id"), "hits")


@query
def text_index(spark, sf):
    return build_text_index(w.table(spark, sf, "documents"), "doc_id", "text").select("word", "doc_id", "hits")


@query
def errors_context(spark, sf):
    return errors_with_context(_sessionized(spark, sf), before=2, after=2).select("session_id", "error_id", "position", "event_id")


@query
def file_blame_last(spark, sf):
    return file_blame(_sessionized(spark, sf)).select("path", "agent_id", "session_id", "event_id", us("ts"))


@query
def file_blame_history(spark, sf):
    return file_blame(_sessionized(spark, sf), history=True).select("path", "recency", "agent_id", "event_id")


@query
def trace_correlate(spark, sf):
    return correlate(w.system_events(spark, sf), _sessionized(spark, sf)).select("event_id", "trace_id", "session_id")


@query
def trace_layers(spark, sf):
    layers = event_layers(w.agent_events(spark, sf), w.system_events(spark, sf))
    return layers.select("layer", "event_id", us("ts"), "trace_id", "span_id", "parent_span_id", "severity", "name", "message",
                         "duration_ms")


@query
def trace_waterfall(spark, sf):
    flow = waterfall(w.agent_events(spark, sf), w.system_events(spark, sf))
    return flow.select("layer", "event_id", "trace_id", "depth", "offset_us", "duration_ms")


@query
def spawn_edge_list(spark, sf):
    return spawn_edges(w.agent_events(spark, sf))


@query
def edges_followed_by(spark, sf):
    return followed_by(_sessionized(spark, sf)).select("session_id", "from_id", "to_id")


@query
def edges_tool_patterns(spark, sf):
    return tool_patterns(_sessionized(spark, sf))


@query
def edges_touched(spark, sf):
    return touched(w.agent_events(spark, sf))


@query
def edges_caused_by(spark, sf):
    return caused_by(w.agent_events(spark, sf))


@query
def edges_owns(spark, sf):
    return owns(_sessionized(spark, sf))


@query
def edges_spawned_sessions(spark, sf):
    return spawned_sessions(_sessionized(spark, sf))


@query
def calls_enriched(spark, sf):
    return enrich_calls(w.agent_events(spark, sf)).select("event_id", "mcp_server", "is_subagent", "severity")


def _memory(spark, sf):
    return memory_view(w.memory_log(spark, sf))


@query
def memory_entries(spark, sf):
    return _memory(spark, sf).select("agent_id", "key", "value", "shared", us("created_at"), us("updated_at"))


@query
def memory_visible(spark, sf):
    return visible(_memory(spark, sf), "agent-1").select("agent_id", "key", "value", "shared")


@query
def memory_list_tagged(spark, sf):
    found = list_memory(_memory(spark, sf), "agent-2", tags=["t1"], limit=20)
    return found.select("agent_id", "key", "value", us("updated_at"))


def _vectors(spark, sf, id_name):
    return w.table(spark, sf, "embeddings").select(F.col("vec_id").alias(id_name), F.col("embedding").alias("vector"))


@query
def memory_search_top(spark, sf):
    """Best entries visible to one agent, for every vector of the table as a query."""
    hits = memory_search(_memory(spark, sf), _vectors(spark, sf, "query_id"), k=5, agent="agent-1")
    return hits.select(F.col("query_id").cast("bigint").alias("query_id"), "rank", "similarity", "agent_id", "key", "value")


@query
def memory_recall(spark, sf):
    """Similar past situations for every vector, itself excluded."""
    hits = recall(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "id"), k=3)
    return hits.select(F.col("query_id").cast("bigint").alias("query_id"), "rank", F.col("id").cast("bigint").alias("id"), "similarity")


@query
def memory_search_indexed(spark, sf):
    """As ``memory_search_top``, through a stored index of the entries that the agent may see."""
    seen = visible(_memory(spark, sf), "agent-1").withColumn("id", memory_id())
    index = VectorIndex(spark, work_dir(spark)).build(seen.select("id", F.col("embedding").alias("vector")))
    hits = index.search(_vectors(spark, sf, "query_id"), k=5).join(seen.drop("embedding"), "id")
    return hits.select(F.col("query_id").cast("bigint").alias("query_id"), "rank", "similarity", "agent_id", "key", "value")


@query
def memory_recall_indexed(spark, sf):
    """As ``memory_recall``, through a stored index."""
    index = VectorIndex(spark, work_dir(spark)).build(_vectors(spark, sf, "id"))
    hits = index.search(_vectors(spark, sf, "query_id"), k=3, skip_self=True)
    return hits.select(F.col("query_id").cast("bigint").alias("query_id"), "rank", F.col("id").cast("bigint").alias("id"), "similarity")


@query
def cosine_self(spark, sf):
    v = w.table(spark, sf, "embeddings")
    return v.select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity"),
                    cosine(F.col("embedding"), noop_vector(64)).alias("with_zero"))


@query
def vector_dims(spark, sf):
    """Vectors of label 0 lose an element and must be refused."""
    v = w.table(spark, sf, "embeddings").select("vec_id", F.when(
        F.col("label") == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"))
    good, bad = check_dims(v, "embedding", 64)
    return good.select("vec_id", F.lit(True).alias("ok")).unionByName(bad.select("vec_id", F.lit(False).alias("ok")))


@query
def noop_embed(spark, sf):
    v = noop_vector(384)
    return w.table(spark, sf, "documents").select(
        "doc_id", F.size(v).alias("dims"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


def load_text_stats():
    """A backend that counts: characters, spaces and line ends of each text."""
    return lambda texts: [[len(t), t.count(" "), t.count("\n")] for t in texts]


@query
def embed_texts(spark, sf):
    docs = embed(w.table(spark, sf, "documents").select("doc_id", "text"), "text", load_text_stats, 3)
    return docs.select("doc_id", *[F.col("embedding")[i].cast("bigint").alias(f"v{i}") for i in range(3)])


@query
def embed_texts_once(spark, sf):
    """Embedded twice: the second time every vector comes from the store."""
    store = VersionedTable(spark, work_dir(spark))
    docs = w.table(spark, sf, "documents").select("doc_id", "text")
    for _ in range(2):
        found = embed_once(docs, "text", store, load_text_stats, 3)
    return found.select("doc_id", *[F.col("embedding")[i].cast("bigint").alias(f"v{i}") for i in range(3)])


@query
def retention_10d(spark, sf):
    return apply_retention(w.agent_events(spark, sf), w.as_of(), days=10).select("event_id", us("ts"))


NOW = {"availableNow": True}


def _stream_dirs(spark, *names):
    base = work_dir(spark)
    return [f"{base}/{n}" for n in (*names, "checkpoint")]


@query
def stream_otlp_traces(spark, sf):
    """The trace payloads through files, a stream and a table; ids differ, they come from the files."""
    source, sink, checkpoint = _stream_dirs(spark, "payloads", "events")
    w.trace_payloads(spark, sf).select(F.col("body").alias("value")).write.text(source)
    stream_otlp(payload_stream(spark, source), "trace", sink, checkpoint, **NOW).awaitTermination()
    return _system_rows(spark.read.parquet(sink)).drop("event_id")


@query
def stream_otlp_logs(spark, sf):
    """The log payloads the same way. Records without a time take that of their file, which is left out."""
    source, sink, checkpoint = _stream_dirs(spark, "payloads", "events")
    w.log_payloads(spark, sf).select(F.col("body").alias("value")).write.text(source)
    stream_otlp(payload_stream(spark, source), "log", sink, checkpoint, **NOW).awaitTermination()
    timed = F.get_json_object("attributes", "$.status") != "P"
    return _system_rows(spark.read.parquet(sink)).drop("event_id").withColumn("ts_us", F.when(timed, F.col("ts_us")))


@query
def stream_otlp_rejects_by_reason(spark, sf):
    """The refused trace payloads of a stream, counted by reason."""
    source, sink, checkpoint = _stream_dirs(spark, "payloads", "rejects")
    w.trace_payloads(spark, sf).select(F.col("body").alias("value")).write.text(source)
    stream_otlp_rejects(payload_stream(spark, source), "trace", sink, checkpoint, **NOW).awaitTermination()
    return spark.read.parquet(sink).groupBy("reason").agg(F.count(F.lit(1)).alias("payloads"))


@query
def stream_closed_sessions(spark, sf):
    """Sessions that the stream has closed: all but those near its end."""
    sink, checkpoint = _stream_dirs(spark, "sessions")
    closed = stream_sessions(w.agent_events(spark, sf, stream=True), HALF_DAY)
    closed.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint) \
        .trigger(**NOW).start().awaitTermination()
    return spark.read.parquet(sink).select(
        "session_id", "agent_id", "session_token", us("started_at"), us("last_event_at"), us("ended_at"), "event_count")


@query
def stream_close_summaries(spark, sf):
    sessions, summaries, retry, checkpoint = _stream_dirs(spark, "sessions", "summaries", "retry")
    closed = stream_sessions(w.agent_events(spark, sf, stream=True), HALF_DAY)
    handler = on_session_close(lambda: w.agent_events(spark, sf), sessions, summaries, retry)
    start_session_closer(closed, handler, checkpoint, **NOW).awaitTermination()
    return spark.read.parquet(summaries).drop("batch_id")


@query
def stream_trace_correlate(spark, sf):
    sink, checkpoint = _stream_dirs(spark, "linked")
    start_correlator(w.system_events(spark, sf, stream=True), lambda: _sessionized(spark, sf), sink, checkpoint, **NOW).awaitTermination()
    return spark.read.parquet(sink).select("event_id", "trace_id", "session_id")


@query
def stream_agent_totals(spark, sf):
    table, checkpoint = _stream_dirs(spark, "agents")
    start_agent_counters(w.agent_events(spark, sf, stream=True), table, checkpoint, **NOW).awaitTermination()
    stored = spark.read.parquet(table)
    newest = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == newest).select("agent_id", us("first_seen"), us("last_seen"), "total_events")


@query
def stream_embed_texts(spark, sf):
    sink, checkpoint = _stream_dirs(spark, "vectors")
    docs = w.table(spark, sf, "documents", stream=True).select("doc_id", "text")
    stream_embed(docs, "text", load_text_stats, 3, sink, checkpoint, **NOW).awaitTermination()
    return spark.read.parquet(sink).select("doc_id", *[F.col("embedding")[i].cast("bigint").alias(f"v{i}") for i in range(3)])


@query
def errors_context_incomplete(spark, sf):
    """Errors and their neighbours where some events have no session token, and so no session."""
    token = F.when(F.get_json_object("params", "$.max_tokens").cast("bigint") % 10 != 7, F.col("session_token"))
    events = sessionize(w.agent_events(spark, sf).withColumn("session_token", token), HALF_DAY)
    return errors_with_context(events, before=2, after=2).select("session_id", "error_id", "position", "event_id")


def _some_without_time(spark, sf):
    """Agent events; those of one value in ten have no time."""
    timed = F.get_json_object("params", "$.max_tokens").cast("bigint") % 10 != 3
    return w.agent_events(spark, sf).withColumn("ts", F.when(timed, F.col("ts")))


@query
def log_search_untimed(spark, sf):
    """A page at the end of the errors, and the next one: rows without a time come last and are not lost."""
    events, last = _some_without_time(spark, sf), _at(1)
    first = search_events(events, severities=["error"], limit=40, after=(last, ""))
    second = search_events(events, severities=["error"], limit=40, after=(None, "5"))
    return first.select(F.lit(1).alias("page"), "event_id", us("ts")).unionAll(second.select(F.lit(2).alias("page"), "event_id", us("ts")))


@query
def agents_merged_by_time(spark, sf):
    """Totals of three batches cut by time, sessions that go on across a cut counted once."""
    events, cuts = w.agent_events(spark, sf), (_at(10), _at(20))
    day = F.unix_micros("ts")
    low, high = (F.unix_micros(F.lit(c).cast("timestamp")) for c in cuts)
    batches = [events.where(day < low), events.where((day >= low) & (day < high)), events.where(day >= high)]
    first, *others = [owner_totals(session_rollup(b, w.as_of(), HALF_DAY)) for b in batches]
    merged = merge_owner_totals(merge_owner_totals(first.unionByName(others[0]), HALF_DAY).unionByName(others[1]), HALF_DAY)
    return agents_of_owners(merged).select("agent_id", us("first_seen"), us("last_seen"), "total_sessions", "total_events")


@query
def append_once_counts(spark, sf):
    """Two batches of events, the second overlapping the first and delivered twice; rows per day with what each commit counted."""
    table = VersionedTable(spark, f"{work_dir(spark)}/events")
    events = w.agent_events(spark, sf).select("event_id", "agent_id", "ts")
    early, late = F.unix_micros("ts") < F.unix_micros(F.lit(_at(16)).cast("timestamp")), F.col("event_id").cast("bigint") % 3 == 0
    counts = [append_once(events.where(early), table, "log", 0)]
    counts += [append_once(events.where(~early | late), table, "log", 1) for _ in range(2)]
    per_day = table.read().groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return per_day.select("day", "events", F.lit(counts[1]["seen"]).cast("bigint").alias("seen"),
                          F.lit(counts[2]["inserted"]).cast("bigint").alias("inserted"))


@query
def retention_removed(spark, sf):
    """What a table holds after retention has removed ten-day-old rows and their files."""
    table = VersionedTable(spark, f"{work_dir(spark)}/events")
    append_once(w.agent_events(spark, sf).select("event_id", "ts"), table, "log", 0)
    enforce_retention(table, datetime.fromtimestamp(w.AS_OF_SECONDS, timezone.utc), days=10)
    table.vacuum(keep=1)
    return table.read().select("event_id", us("ts"))


@query
def memory_compacted(spark, sf):
    """Live entries of a log that was compacted in its middle."""
    log, memory = w.memory_log(spark, sf), MemoryLog(VersionedTable(spark, f"{work_dir(spark)}/memory"))
    last = log.agg(F.max("seq")).first()[0]
    early, middle = F.col("seq") < last // 3, F.col("seq") < last // 2
    for part in (early, ~early & middle):
        memory.append(log.where(part))
    memory.compact()
    memory.append(log.where(~middle))
    return memory.view().select("agent_id", "key", "value", "shared", us("created_at"), us("updated_at"))


def _file_stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


@query
def stream_closed_sessions_closes(spark, sf):
    """Sessions that a stream of events and close requests has closed, with state and end."""
    source, state, sessions, late, checkpoint = _stream_dirs(spark, "activity", "state", "sessions", "late")
    rows = activity(w.agent_events(spark, sf), _commit_closes(spark, sf))
    middle = F.unix_micros("ts") < F.unix_micros(F.lit(_at(16)).cast("timestamp"))
    closer = SessionCloser(spark, state, sessions, late, HALF_DAY)
    for part in (middle, ~middle):  # the stream stops and goes on
        rows.where(part).write.mode("append").parquet(source)
        closer.start(_file_stream(spark, source, rows.schema), checkpoint, **NOW).awaitTermination()
    return spark.read.parquet(sessions).select(
        "session_id", "session_token", "agent_id", "status", "project_dir", "git_branch", us("started_at"), us("ended_at"),
        us("last_event_at"), "event_count")


@query
def stream_agent_sessions(spark, sf):
    """Totals of all agents while the stream is open, sessions that have not closed yet included."""
    state, sessions, late, checkpoint = _stream_dirs(spark, "state", "sessions", "late")
    closer = SessionCloser(spark, state, sessions, late, HALF_DAY)
    closer.start(activity(w.agent_events(spark, sf, stream=True)), checkpoint, **NOW).awaitTermination()
    return closer.agents().select("agent_id", us("first_seen"), us("last_seen"), "total_sessions", "total_events")


@query
def stream_trace_relink(spark, sf):
    """System events come first and are linked again as the agent events arrive."""
    source, agents, state, sink, checkpoint = _stream_dirs(spark, "rows", "agents", "state", "linked")
    system = w.system_events(spark, sf).select(F.lit("system").alias("kind"), "event_id", "trace_id", "ts")
    stored = _sessionized(spark, sf).select("event_id", "trace_id", "ts", "session_id")
    linker = TraceLinker(spark, state, sink, lambda: spark.read.schema(stored.schema).parquet(agents), keep=timedelta(days=1000))
    middle = F.unix_micros("ts") >= F.unix_micros(F.lit(_at(16)).cast("timestamp"))
    stored.limit(0).write.parquet(agents)
    for rows in (system, stored.where(middle), stored.where(~middle)):  # later agent events first: links change
        if "kind" not in rows.columns:
            rows.write.mode("append").parquet(agents)
            rows = rows.select(F.lit("agent").alias("kind"), "event_id", "trace_id", "ts")
        rows.write.mode("append").parquet(source)
        linker.start(_file_stream(spark, source, system.schema), checkpoint, **NOW).awaitTermination()
    return linker.linked().select("event_id", "trace_id", "session_id")


@query
def edges_spans(spark, sf):
    """Parent and child by span over agent and system events, across the two layers as well."""
    return span_edges(event_layers(w.agent_events(spark, sf), w.system_events(spark, sf)))


@query
def calls_enriched_mixed(spark, sf):
    """Calls of which some start a sub-agent and some report an error in their output."""
    number = F.col("event_id").cast("bigint")
    calls = w.agent_events(spark, sf).withColumns({
        "tool_name": F.when(number % 5 == 0, "Agent").otherwise(F.col("tool_name")),
        "result": F.when(number % 7 == 0, '{"error":{"code":1}}').when(number % 7 == 1, "not JSON").when(number % 7 == 2, None).otherwise(F.col("result")),
    })
    return enrich_calls(calls).select("event_id", "mcp_server", "is_subagent", "severity")


@query
def hybrid_retrieval(spark, sf):
    """For every vector as a query: events without an error, alike or within three causes of the event of that number."""
    events, vectors = w.agent_events(spark, sf), _vectors(spark, sf, "id")
    nodes = search_events(events, severities=["info", "warn"]).join(vectors, F.col("event_id") == F.col("id")).select("id", "vector")
    found = hybrid_search(
        vectors.withColumnRenamed("id", "query_id"), vectors.select(F.col("id").alias("query_id"), "id"),
        both_ways(caused_by(events), "parent_id", "child_id"), nodes, hops=3, k=10)
    return found.withColumn("query_id", F.col("query_id").cast("bigint"))
