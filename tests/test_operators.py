"""Trace, memory, similarity, search and text operators on small inputs."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions.vectors import cosine, noop_vector
from tracewell.operators.edges import span_edges
from tracewell.operators.embedding import check_dims, embed
from tracewell.operators.memory import memory_view, visible
from tracewell.operators.ordering import number_rows
from tracewell.operators.retention import apply_retention
from tracewell.operators.rollups import agent_rollup, merge_agents, new_agents, valid_agents
from tracewell.operators.search import errors_with_context, newest_first
from tracewell.operators.similarity import BLOCK_VALUES, block_count, memory_search, nearest
from tracewell.operators.text_index import build_text_index, search_text_index, text_search, write_text_index
from tracewell.operators.traces import correlate, span_depths, waterfall

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_span_depths(spark):
    rng = random.Random(1)
    nodes, depth = [], {}
    for i in range(300):
        parent = rng.randrange(i) if i and rng.random() < 0.95 else None
        depth[i] = 0 if parent is None else depth[parent] + 1
        nodes.append(("t", f"s{i}", None if parent is None else f"s{parent}"))
    chain = [("c", f"s{i}", f"s{i - 1}") for i in range(100)]
    orphan = [("o", "x", "ghost"), ("o", "y", "x"), ("t2", "s5", "s4")]
    cycle = [("y", "a", "b"), ("y", "b", "a"), ("y", "c", "a"), ("y", "d", "d"), ("y", "r", None)]
    df = spark.createDataFrame(nodes + chain + orphan + cycle, "trace_id string, span_id string, parent_span_id string")
    got = {(r.trace_id, r.span_id): r.depth for r in span_depths(df).collect()}
    expected = {("t", f"s{i}"): d for i, d in depth.items()} | {("c", f"s{i}"): i for i in range(100)}
    expected |= {("o", "x"): 0, ("o", "y"): 1, ("t2", "s5"): 0, ("y", "r"): 0}
    expected |= {("y", k): None for k in "abcd"}
    assert got == expected


AGENT = "event_id string, session_id string, ts timestamp, trace_id string, span_id string, parent_span_id string, severity string, " \
        "tool_name string, message string, duration_ms bigint"
SYSTEM = "event_id string, ts timestamp, trace_id string, span_id string, parent_span_id string, severity string, event_name string, " \
         "message string, duration_ms bigint, session_id string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def layers(spark):
    agent = spark.createDataFrame([
        ("a1", "S2", at(5), "t1", "p", None, "info", "Bash", "m", 1), ("a2", "S1", at(2), "t1", "q", "p", "info", "Bash", "m", 1),
        ("a3", "S3", at(1), "", "z", None, "info", "Bash", "m", 1), ("a4", "S4", at(1), None, "z", None, "info", "Bash", "m", 1)], AGENT)
    system = spark.createDataFrame([
        ("s1", at(3), "t1", "r", "q", "info", "op", None, 1, None), ("s2", at(4), "t9", "r", None, "info", "op", None, 1, None),
        ("s3", at(4), "", "r", None, "info", "op", None, 1, None), ("s4", at(4), None, "r", None, "info", "op", None, 1, None),
        ("s5", at(9), "t1", "r", None, "info", None, "log line of span r", None, None)], SYSTEM)
    return agent, system


def test_correlate(spark):
    agent, system = layers(spark)
    got = {r.event_id: r.session_id for r in correlate(system, agent).collect()}
    assert got == {"s1": "S1", "s2": None, "s3": None, "s4": None, "s5": "S1"}


@pytest.mark.parametrize("trace", [None, "t1"])
def test_waterfall(spark, trace):
    agent, system = layers(spark)
    got = {r.event_id: (r.layer, r.depth, r.offset_us) for r in waterfall(agent, system, trace).collect()}
    expected = {"a1": ("agent", 0, 3_000_000), "a2": ("agent", 1, 0), "s1": ("system", 2, 1_000_000), "s5": ("system", 2, 7_000_000)}
    assert got == expected | ({} if trace else {"s2": ("system", 0, 0)})


def test_memory_view(spark):
    rng = random.Random(3)
    log = [("a" if rng.random() < 0.6 else "b", rng.choice("kl"), f"v{i}", rng.random() < 0.3, "delete" if rng.random() < 0.25 else "put",
            at(i // 2), i) for i in range(120)] + [("c", "only", "v", True, "put", at(0), 500), ("c", "gone", "v", True, "delete", at(0), 501)]
    df = spark.createDataFrame(log, "agent_id string, key string, value string, shared boolean, op string, ts timestamp, seq bigint")
    state = {}
    for agent, key, value, shared, op, ts, seq in sorted(log, key=lambda r: (r[5], r[6])):
        if op == "delete":
            state.pop((agent, key), None)
        else:
            created = state[agent, key][2] if (agent, key) in state else ts
            state[agent, key] = (value, shared, created, ts)
    view = memory_view(df)
    got = {(r.agent_id, r.key): (r.value, r.shared, r.created_at, r.updated_at) for r in view.collect()}
    assert got == {k: (v, s, c.replace(tzinfo=None), u.replace(tzinfo=None)) for k, (v, s, c, u) in state.items()}
    seen = {(r.agent_id, r.key) for r in visible(view, "a").collect()}
    assert seen == {k for k, v in state.items() if k[0] == "a" or v[1]}


def vectors(spark, n, dims, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(f"{name}{i}", rng.normal(size=dims).round(1).tolist()) for i in range(n)]
    rows += [(f"{name}zero", [0.0] * dims), (f"{name}short", [1.0]), (f"{name}twin1", [1.0] * dims), (f"{name}twin2", [2.0] * dims)]
    return rows


def brute(queries, candidates, k, skip_self):
    result = {}
    for q, qv in queries:
        scored = []
        for c, cv in candidates:
            if len(qv) == len(cv) and (not skip_self or c != q):
                norm = np.linalg.norm(qv) * np.linalg.norm(cv)
                if norm:
                    scored.append((-round(float(np.dot(qv, cv) / norm), 9), c))
        result[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return {q: r for q, r in result.items() if r}


@pytest.mark.parametrize("skip_self", [False, True])
def test_nearest(spark, skip_self, monkeypatch):
    monkeypatch.setattr("tracewell.operators.similarity.QUERY_BLOCK", 7)
    monkeypatch.setattr("tracewell.operators.similarity.CANDIDATE_CHUNK", 11)
    rows = vectors(spark, 40, 4, 1, "v")
    queries = rows  # of several lengths
    assert len({len(v) for _, v in rows}) > 1
    cdf = spark.createDataFrame([*rows, ("null", None)], "id string, vector array<double>").repartition(3)
    qdf = spark.createDataFrame([("none", None), *queries, queries[0]], "query_id string, vector array<double>")
    got = {}
    for r in nearest(qdf, cdf, 3, skip_self).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    expected = brute(queries, rows, 3, skip_self)
    assert {q: [c for c, _ in r] for q, r in got.items()} == {q: [c for c, _ in r] for q, r in expected.items()}
    for q, r in got.items():
        assert [s for _, s in r] == pytest.approx([s for _, s in expected[q]], abs=1e-9)


def test_nearest_copies_candidates_once_a_block(spark):
    """Blocks follow the tasks at once and the size that a task may hold, not the number of queries."""
    queries = spark.range(20_000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    assert block_count(queries, 3) == max(2, spark.sparkContext.defaultParallelism)
    assert block_count(queries, 1 << 10) == math.ceil(20_000 * (1 << 10) / BLOCK_VALUES)


def test_nearest_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr("tracewell.operators.similarity.QUERY_BLOCK", 16)
    rng = np.random.default_rng(9)
    rows = [(f"c{i:04d}", rng.integers(-2, 3, size=3).astype(float).tolist()) for i in range(900)]  # many ties
    rows += [("c0007", rows[8][1]), ("hole", [None, 1.0, 1.0])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        cdf = spark.createDataFrame(rows, "id string, vector array<double>")
        found = nearest(spark.createDataFrame(rows[:60], "query_id string, vector array<double>"), cdf, 5, True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = brute(rows[:60], rows[:-1], 5, True)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: [c for c, _ in r] for q, r in expected.items()}


def test_memory_search_respects_visibility(spark):
    memory = spark.createDataFrame(
        [("a", "k", "mine", False, [1.0, 0.0]), ("b", "k", "hidden", False, [1.0, 0.0]), ("b", "l", "shared", True, [0.0, 1.0])],
        "agent_id string, key string, value string, shared boolean, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, vector array<double>")
    assert [r.value for r in memory_search(memory, queries, 5, "a").orderBy("rank").collect()] == ["mine", "shared"]
    assert memory_search(memory, queries, 5).count() == 3
    assert memory_search(memory, queries.where("false"), 5).count() == 0


def test_cosine_and_noop(spark):
    row = spark.range(1).select(
        F.size(noop_vector(384)).alias("dims"), cosine(noop_vector(2), F.array(F.lit(1.0), F.lit(2.0))).alias("zero"),
        cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("lengths"),
        cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))).alias("c")).first()
    assert (row.dims, row.zero, row.lengths) == (384, None, None) and row.c == pytest.approx(0.96)


def test_embed(spark):
    rows = [(i, None if i % 7 == 0 else "x" * i) for i in range(50)]
    df = spark.createDataFrame(rows, "i bigint, text string").repartition(4)
    out = embed(df, "text", lambda: lambda texts: [[len(t), 1.0] for t in texts], 2)
    assert {r.i: r.embedding for r in out.collect()} == {i: None if t is None else [float(len(t)), 1.0] for i, t in rows}
    good, bad = check_dims(out, "embedding", 2)
    assert (good.count(), bad.count()) == (42, 8)
    with pytest.raises(Exception, match="backend returned shape"):
        embed(df, "text", lambda: lambda texts: [[1.0]] * len(texts), 2).collect()


def test_text_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The cat, the HAT."), (2, "cat-hat É"), (3, "category hats"), (4, ""), (5, None)], "id bigint, t string")
    index = build_text_index(docs, "id", "t")
    for _ in range(2):  # a repeated write changes no answer
        write_text_index(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    for query, expected in {"cat hat": {(1, 2), (2, 2)}, "THE": {(1, 2)}, "é": {(2, 1)}, "none": set(),
                            "cat, hat!": {(1, 2), (2, 2)}, "cat-hat": {(1, 2), (2, 2)}, "": set(), " -- ": set()}.items():
        assert {tuple(r) for r in text_search(docs, "id", "t", query).collect()} == expected
        assert {tuple(r) for r in search_text_index(index, "id", query).collect()} == expected
        assert {tuple(r) for r in search_text_index(stored, "id", query).collect()} == expected


def test_errors_with_context_in_one_large_session(spark):
    rows = [(f"e{i:04d}", "s", at(i * 7), "error" if i % 50 == 0 else "info", "Bash", "m") for i in range(500)]
    df = spark.createDataFrame(rows, "event_id string, session_id string, ts timestamp, severity string, tool_name string, message string")
    got = {(r.error_id, r.position, r.event_id) for r in errors_with_context(df, 2, 1).collect()}
    assert got == {(f"e{e:04d}", d, f"e{e + d:04d}") for e in range(0, 500, 50) for d in (-2, -1, 0, 1) if 0 <= e + d < 500}


def test_paging(spark):
    rows = [(f"e{i:03d}", at(i // 4)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id string, ts timestamp")
    seen, after = [], None
    while page := newest_first(df, 17, after).collect():
        seen += [r.event_id for r in page]
        after = (page[-1].ts.replace(tzinfo=timezone.utc), page[-1].event_id)
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))]


def test_agents(spark):
    events = spark.createDataFrame([("a", at(1)), ("a", at(2)), ("b", at(3)), ("no good", at(1)), (None, at(1))], "agent_id string, ts timestamp")
    good, bad = valid_agents(events)
    assert (good.count(), bad.count()) == (3, 2)
    known = spark.createDataFrame([("b",)], "agent_id string")
    assert [(r.agent_id, r.total_events) for r in new_agents(events, known).collect()] == [("a", 2)]
    schema = "agent_id string, started_at timestamp, last_event_at timestamp, event_count bigint"
    sessions = spark.createDataFrame([("a", at(0), at(5), 3), ("a", at(9), at(10), 1), ("b", at(0), at(7200), 2)], schema)
    rolled = agent_rollup(sessions, F.lit(at(7300)), idle_after=timedelta(hours=1), offline_after=timedelta(hours=2))
    assert {r.agent_id: (r.total_sessions, r.total_events, r.status) for r in rolled.collect()} == {"a": (2, 4, "offline"), "b": (1, 2, "active")}
    merged = merge_agents(rolled, rolled.where("agent_id = 'a'"))
    assert {r.agent_id: (r.total_sessions, r.total_events) for r in merged.collect()} == {"a": (4, 8), "b": (1, 2)}


def test_retention(spark):
    df = spark.createDataFrame([(i, START - timedelta(days=i)) for i in range(100)], "i int, ts timestamp")
    assert apply_retention(df, F.lit(START)).count() == 91
    dated = df.withColumn("event_date", F.to_date("ts"))
    assert apply_retention(dated, F.lit(START), days=5).count() == 6


def test_rows_without_a_time_come_last(spark):
    rows = [("s", "b", None), ("s", "a", None), ("s", "c", at(5)), ("s", "d", at(500)), ("t", "e", None)]
    df = spark.createDataFrame(rows, "session_id string, event_id string, ts timestamp")
    got = {r.event_id: r.n for r in number_rows(df, ["session_id"], "ts", "event_id", "n").collect()}
    assert got == {"c": 1, "d": 2, "a": 3, "b": 4, "e": 1}


def test_empty_span_ids_link_nothing(spark):
    rows = [(f"e{i}", "t", "", "") for i in range(50)] + [("p", "t", "1", None), ("c", "t", "2", "1"), ("n", "t", None, "2")]
    df = spark.createDataFrame(rows, "event_id string, trace_id string, span_id string, parent_span_id string")
    assert {(r.parent_id, r.child_id) for r in span_edges(df).collect()} == {("p", "c"), ("c", "n")}
