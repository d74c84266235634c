"""Tables under manifests: appends, retention, compaction, readers and failures."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracewell.operators.memory import KEY, MemoryLog, compact_log, memory_view
from tracewell.operators.retention import apply_retention, enforce_retention
from tracewell.plans import workload as w
from tracewell.sources.sinks import append_once
from tracewell.sources.versions import CommitConflict, VersionedTable, rows_of


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "table"))


def files(table):
    return sorted(f for _, _, names in os.walk(f"{table.root}/data") for f in names if f.endswith(".parquet"))


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_states(spark, table):
    schema = spark.range(1).schema
    assert table.manifest().version == -1 and rows_of(table, schema).count() == 0
    with pytest.raises(ValueError):
        table.read()
    first = table.replace(table.manifest(), spark.range(3), {"a": 1})
    second = table.commit(first, first.folders + table.write(spark.range(3, 5)), schema, {"a": 2})
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4]
    assert table.read(first).count() == 3 and table.manifest().info == {"a": 2} and table.versions() == [0, 1]
    # a second writer on an old state fails, and what it wrote is removed later
    with pytest.raises(CommitConflict):
        table.replace(first, spark.range(9), {})
    assert table.manifest() == second and not [n for n in os.listdir(f"{table.root}/_manifests") if n.startswith(".") and not n.endswith(".crc")]
    assert table.vacuum(keep=2) == 1 and table.read().count() == 5 and table.read(first).count() == 3
    third = table.replace(second, spark.range(1), {})
    reading = table.read(second)
    assert table.vacuum(keep=2) == 0 and reading.count() == 5
    assert table.vacuum(keep=1) == 2 and table.versions() == [third.version] and table.read().count() == 1
    empty = table.commit(third, [], schema, {})
    assert table.read(empty).count() == 0


def batch(spark, rows):
    return spark.createDataFrame(rows, "event_id string, ts timestamp, note string")


DAY = datetime(2024, 1, 10, 12)


def test_append_once(spark, table):
    rows = [("a", DAY, "x"), ("b", DAY + timedelta(days=1), "x"), ("b", DAY + timedelta(days=1), "x"), ("c", None, None)]
    assert append_once(batch(spark, rows), table, "s", 0) == {"seen": 4, "inserted": 3}
    assert append_once(batch(spark, rows), table, "s", 0) == {"seen": 4, "inserted": 3}
    assert ids(table.read()) == ["a", "b", "c"] and table.manifest().version == 0
    assert append_once(batch(spark, [("a", DAY, "y"), ("d", DAY, "y"), ("c", None, "y")]), table, "s", 1) == {"seen": 3, "inserted": 1}
    assert append_once(batch(spark, rows), table, "s", 0) == {"seen": 0, "inserted": 0}
    # another source has numbers of its own
    assert append_once(batch(spark, [("e", DAY, "z")]), table, "t", 0) == {"seen": 1, "inserted": 1}
    assert append_once(batch(spark, [("e", DAY, "z")]), table, "t", 1, unique=None) == {"seen": 1, "inserted": 1}
    assert ids(table.read()) == ["a", "b", "c", "d", "e", "e"]
    assert append_once(batch(spark, []), table, "u", 0) == {"seen": 0, "inserted": 0}


def test_a_failed_append_leaves_the_table(spark, table):
    append_once(batch(spark, [("a", DAY, "x")]), table, "s", 0)
    broken = batch(spark, [("b", DAY, "x")]).withColumn("note", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        append_once(broken, table, "s", 1)
    assert ids(table.read()) == ["a"] and table.manifest().version == 0
    assert append_once(batch(spark, [("b", DAY, "x")]), table, "s", 1) == {"seen": 1, "inserted": 1}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_retention_removes_files(spark, table, zone):
    start = datetime(2024, 1, 1, 0, 30, tzinfo=timezone.utc)
    rows = [(str(h), start + timedelta(hours=h), "x") for h in range(0, 240, 6)] + [("none", None, None)]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        append_once(batch(spark, rows), table, "s", 0)
        as_of = datetime(2024, 1, 11, 13)
        before, reading = files(table), table.read()
        assert enforce_retention(table, as_of, days=5) == {"dropped": 5, "rewritten": 1}
        kept = [i for i, t, _ in rows if t is None or t >= (as_of - timedelta(days=5)).replace(tzinfo=timezone.utc)]
        assert ids(table.read()) == sorted(kept)
        limit = F.timestamp_seconds(F.lit(int(as_of.replace(tzinfo=timezone.utc).timestamp())))
        assert ids(apply_retention(batch(spark, rows), limit, 5)) == sorted(set(kept) - {"none"})
        assert reading.count() == len(rows)  # a reader of the old state still sees it
        assert table.vacuum(keep=1) == 6 and len(files(table)) < len(before)
        assert ids(table.read()) == sorted(kept)
        assert enforce_retention(table, datetime(2024, 1, 11, 13), days=100) == {"dropped": 0, "rewritten": 0}
        assert append_once(batch(spark, rows), table, "s", 0)["inserted"] == len(rows)  # known, and not stored again
        assert ids(table.read()) == sorted(kept)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def entries(df):
    return sorted((tuple(r) for r in df.select(*KEY, "value", "shared", "created_at", "updated_at").collect()), key=repr)


@pytest.mark.parametrize("cut", [0, 1, 17, 40, 400])
def test_compaction_in_the_middle(spark, sf_dir, table, cut):
    log = w.memory_log(spark, sf_dir).drop("embedding")
    memory = MemoryLog(table)
    memory.append(log.where(F.col("seq") < cut))
    memory.append(log.where((F.col("seq") >= cut) & (F.col("seq") < cut + 40)))
    memory.compact()
    # the tail also brings an older put out of order
    memory.append(log.where(F.col("seq") >= cut + 40))
    assert entries(memory.view()) == entries(memory_view(log)) and table.manifest().version == 3
    memory.compact()
    assert entries(memory.view()) == entries(memory_view(log))
    assert table.read().count() <= 3 * log.select(*KEY).distinct().count()
    memory.compact()
    assert table.manifest().version == 4  # one folder needs no more


def test_compacted_keys(spark):
    at = datetime(2024, 1, 1)
    rows = [("a", k, f"v{s}", False, op, at + timedelta(minutes=s), s) for k, ops in
            (("put", "ppp"), ("gone", "ppd"), ("back", "pdpp"), ("twice", "pdpdp"), ("only", "d")) for s, op in
            enumerate({"p": "put", "d": "delete"}[o] for o in ops)]
    log = spark.createDataFrame(rows, "agent_id string, key string, value string, shared boolean, op string, ts timestamp, seq long")
    kept = {}
    for r in compact_log(log).collect():
        kept.setdefault(r.key, []).append(r.seq)
    assert {k: sorted(v) for k, v in kept.items()} == {"put": [0, 2], "gone": [2], "back": [1, 2, 3], "twice": [3, 4], "only": [0]}
    late = spark.createDataFrame([("a", k, "old", False, "put", at - timedelta(hours=1), -1) for k in ("put", "gone", "back")], log.schema)
    assert entries(memory_view(compact_log(log).union(late))) == entries(memory_view(log.union(late)))
