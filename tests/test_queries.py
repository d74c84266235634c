"""Every registered query against its SQL, on the smallest tables."""

import math
import re

import duckdb
import pytest

from tracewell.plans.oracles import ORACLES
from tracewell.plans.registry import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return str(round(value, 6) + 0.0)
    return str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert len(set(df.columns)) == len(df.columns)
    got, expected = rows(df.columns, df.collect()), rows(names, cursor.fetchall())
    assert got == expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, tmp_path, sf_dir):
    from tracewell.operators.search import search_events
    from tracewell.plans import workload as w
    w.agent_events(spark, sf_dir).write.parquet(str(tmp_path / "events"))
    found = search_events(spark.read.parquet(str(tmp_path / "events")), agent="agent-1", severities=["error"], limit=5)
    plan = plan_of(found.select("event_id", "ts"))
    assert "TakeOrderedAndProject" in plan
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(agent_id,agent-1\)", plan)
    assert "params" not in plan


def test_payloads_are_parsed_once(spark, sf_dir, tmp_path):
    from tracewell.plans import workload as w
    from tracewell.sources.otlp import read_otlp_traces
    w.trace_payloads(spark, sf_dir).write.parquet(str(tmp_path / "payloads"))
    decoded = read_otlp_traces(spark.read.parquet(str(tmp_path / "payloads")))
    for df in decoded:
        assert plan_of(df).count("from_json(") == 1 and "Exchange" not in plan_of(df)
    assert plan_of(QUERIES["hook_events"](spark, sf_dir)).count("from_json(") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_single_task_window(spark, sf_dir, name):
    if name.startswith("stream_") or name in ("append_by_day", "append_once_counts", "retention_removed", "memory_compacted", "trace_waterfall"):
        pytest.skip("its plan only reads back what the query has written")
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition"):
        assert operator not in plan
