"""Sessions of a stream with close requests, late rows and repeated batches, against the batch operators; relinking and retries."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracewell.operators.rollups import agent_totals, agents_of_owners, merge_owner_totals, owner_totals
from tracewell.operators.search import errors_with_context, newest_first
from tracewell.operators.sessions import session_rollup, sessionize
from tracewell.operators.summaries import session_summary
from tracewell.plans import workload as w
from tracewell.sources.sinks import utc_date
from tracewell.streaming.closes import ACTIVITY, SessionCloser, activity
from tracewell.streaming.relink import TraceLinker
from tracewell.streaming.sessions import on_session_close, retry_summaries

GAP = timedelta(minutes=30)
START = datetime(2024, 3, 9, 22, tzinfo=timezone.utc)


def rows_of_day(seed, n=400):
    """Rows of a few owners in time order: events in bursts, close requests between them and at their instants."""
    rng, rows, at = random.Random(seed), [], START
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 20, 300, 1799, 1800, 1801, 4000]))
        owner = (f"a{rng.choice([0, 0, 0, 1])}", f"t{rng.randrange(2)}")
        rows.append(("event", *owner, at, f"e{i:04}", f'{{"project_dir":"p{i % 3}","git_branch":"b{i % 2}"}}'))
        if rng.random() < 0.12:
            rows.append(("close", *owner, at + timedelta(seconds=rng.choice([0, 0, 5, 1800, 1801])), None, None))
    return rows


COLUMNS = ("session_id", "agent_id", "session_token", "status", "project_dir", "git_branch", "started_at", "ended_at", "last_event_at", "event_count")


def batch_sessions(spark, rows, as_of):
    frame = spark.createDataFrame(rows, ACTIVITY)
    closes = frame.where("kind = 'close'").select("agent_id", "session_token", F.col("ts").alias("closed_at"))
    return session_rollup(frame.where("kind = 'event'"), F.lit(as_of), GAP, closes=closes)


def tuples(df, columns=COLUMNS):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def closer_of(spark, tmp_path):
    return SessionCloser(spark, str(tmp_path / "state"), str(tmp_path / "sessions"), str(tmp_path / "late"), GAP, timedelta(minutes=10))


def test_any_cut_gives_the_batch_sessions(spark, tmp_path):
    rows, rng = rows_of_day(1), random.Random(2)
    # rows are shuffled within the delay, and batches are cut anywhere, one empty, two delivered twice
    order = sorted(rows, key=lambda r: r[3] + timedelta(seconds=rng.randrange(590)))
    cuts = [0, *sorted(rng.sample(range(len(order)), 4)), len(order)]
    batches = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    batches.insert(2, [])
    closer = closer_of(spark, tmp_path)
    for i, some in enumerate(batches):
        frame = spark.createDataFrame(some, ACTIVITY)
        closer(frame, i)
        if i in (1, 3):
            closer(frame, i)
    end = max(r[3] for r in rows if r[0] == "event") - timedelta(minutes=10)
    expected = batch_sessions(spark, rows, max(r[3] for r in rows) + timedelta(days=2))
    over = expected.where(F.when(F.col("status") == "completed", F.col("ended_at") < F.lit(end)).otherwise(F.col("ended_at") < F.lit(end)))
    got = spark.read.parquet(str(tmp_path / "sessions"))
    assert tuples(got) == tuples(over) and got.where("status = 'completed'").count() > 5
    assert spark.read.parquet(str(tmp_path / "late")).count() == 0
    totals = ("agent_id", "first_seen", "last_seen", "total_sessions", "total_events")
    assert tuples(closer.agents(), totals) == tuples(agent_totals(expected), totals)
    assert len(closer.state.versions()) <= 2


def test_late_and_incomplete_rows_have_a_table(spark, tmp_path):
    closer = closer_of(spark, tmp_path)

    def event(i, minutes, agent="a"):
        return ("event", agent, "t", None if minutes is None else START + timedelta(minutes=minutes), f"e{i}", "{}")

    closer(spark.createDataFrame([event(0, 0), event(1, 60), event(2, None), event(3, 5, None)], ACTIVITY), 0)
    closer(spark.createDataFrame([event(4, 49), event(5, 50), ("close", "a", "t", START, None, None), event(6, 200)], ACTIVITY), 1)
    late = spark.read.parquet(str(tmp_path / "late"))
    assert sorted((r.kind, r.event_id or "", r.reason, r.batch_id) for r in late.collect()) == [
        ("close", "", "late", 1), ("event", "e2", "incomplete", 0), ("event", "e3", "incomplete", 0), ("event", "e4", "late", 1)]
    got = tuples(spark.read.parquet(str(tmp_path / "sessions")), ("started_at", "event_count"))
    assert [n for _, n in got] == [1, 2]


def test_restart_through_a_stream(spark, sf_dir, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    rows, closer = activity(w.agent_events(spark, sf_dir)), closer_of(spark, tmp_path)
    for part in range(2):
        rows.where(F.floor(F.unix_micros("ts") / (10 * 86_400_000_000)) % 2 == part).write.mode("append").parquet(source)
        closer.start(spark.readStream.schema(rows.schema).parquet(source), checkpoint, availableNow=True).awaitTermination()
    seen = spark.read.parquet(str(tmp_path / "late")).count() + closer.agents().agg(F.sum("total_events")).first()[0]
    assert seen == rows.count()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_summaries_in_any_zone(spark, tmp_path, zone):
    """Stored events are partitioned by UTC day; the sessions around midnight are found whatever the session's zone."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        events = w.agent_events(spark, "/root/testdata/sf0.001").where(F.col("agent_id") == "agent-1")
        events.withColumn("event_date", utc_date(F.col("ts"))).write.partitionBy("event_date").parquet(str(tmp_path / "events"))
        sessions = session_rollup(events, w.as_of(), timedelta(hours=12)).select("session_id", "agent_id", "session_token", "started_at", "last_event_at")
        paths = [str(tmp_path / n) for n in ("closed", "summaries", "retry")]
        for i, row in enumerate(sessions.orderBy("started_at").limit(3).collect()):
            on_session_close(lambda: spark.read.parquet(str(tmp_path / "events")), *paths)(sessions.where(F.col("session_id") == row.session_id), i)
        expected = session_summary(sessionize(events, timedelta(hours=12))).select("session_id", "event_count")
        got = spark.read.parquet(paths[1]).select("session_id", "event_count")
        assert got.count() == 3 and got.exceptAll(expected).isEmpty()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_a_summary_that_fails_twice_appears_once(spark, sf_dir, tmp_path):
    events = w.agent_events(spark, sf_dir)
    sessions = session_rollup(events, w.as_of(), timedelta(hours=12)).select("session_id", "agent_id", "session_token", "started_at", "last_event_at")
    closed, summaries, retry = (str(tmp_path / n) for n in ("closed", "summaries", "retry"))

    def broken(rows):
        raise RuntimeError("not now")

    for i in range(2):
        on_session_close(lambda: events, closed, summaries, retry, broken)(sessions.where(F.abs(F.xxhash64("session_id")) % 2 == i).limit(20), i)
    job = (spark, lambda: events, closed, summaries, retry)
    assert retry_summaries(*job, broken) == {"done": 0, "failed": 2, "given_up": 0}
    assert spark.read.parquet(retry).agg(F.min("attempts"), F.max("attempts")).first() == (2, 2)
    assert retry_summaries(*job, broken, most=2) == {"done": 0, "failed": 0, "given_up": 2}
    assert retry_summaries(*job) == {"done": 2, "failed": 0, "given_up": 0}
    assert retry_summaries(*job) == {"done": 0, "failed": 0, "given_up": 0}
    assert sorted(r.session_id for r in spark.read.parquet(summaries).collect()) == sorted(r.session_id for r in spark.read.parquet(closed).collect())


def test_relinking(spark, tmp_path):
    agents = spark.createDataFrame([], "event_id string, trace_id string, ts timestamp, session_id string")
    stored = [agents]
    linker = TraceLinker(spark, str(tmp_path / "state"), str(tmp_path / "out"), lambda: stored[0], keep=timedelta(hours=1))
    fields = "kind string, event_id string, trace_id string, ts timestamp"

    def at(minutes):
        return START + timedelta(minutes=minutes)

    def send(batch_id, *rows, sessions=()):
        if sessions:
            stored[0] = stored[0].unionAll(spark.createDataFrame(list(sessions), agents.schema))
        frame = spark.createDataFrame(list(rows), fields)
        linker(frame, batch_id)
        linker(frame, batch_id)
        return sorted(((r.event_id, r.session_id, r.update) for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("batch_id") == batch_id).collect()), key=repr)

    assert send(0, ("system", "s1", "x", at(0)), ("system", "s2", "", at(0)), ("system", "s3", None, at(0)), ("system", "s4", "y", at(0))) == [
        ("s1", None, False), ("s2", None, False), ("s3", None, False), ("s4", None, False)]
    assert send(1, ("agent", "a1", "x", at(9)), sessions=[("a1", "x", at(9), "late")]) == [("s1", "late", True)]
    # the same session is not told again, an earlier agent event of the trace is
    assert send(2, ("agent", "a2", "x", at(10)), ("system", "s5", "x", at(11)), sessions=[("a2", "x", at(10), "later")]) == [("s5", "late", False)]
    assert send(3, ("agent", "a0", "x", at(1)), sessions=[("a0", "x", at(1), "early")]) == [("s1", "early", True), ("s5", "early", True)]
    # beyond the time it waits an event is not linked any more
    assert send(4, ("system", "s6", "z", at(90))) == [("s6", None, False)]
    assert send(5, ("agent", "a3", "y", at(91)), sessions=[("a3", "y", at(91), "y")]) == []
    assert send(6) == []
    assert {r.event_id: r.session_id for r in linker.linked().collect()} == {
        "s1": "early", "s2": None, "s3": None, "s4": None, "s5": "early", "s6": None}


def test_totals_of_batches_cut_by_time(spark):
    rows = [r for r in rows_of_day(4, 300) if r[0] == "event"]
    whole = session_rollup(spark.createDataFrame(rows, ACTIVITY), F.lit(START), GAP)
    edges = [0, 37, 38, 150, 299, len(rows)]
    rows.sort(key=lambda r: r[3])
    parts = [owner_totals(session_rollup(spark.createDataFrame(rows[a:b], ACTIVITY), F.lit(START), GAP)) for a, b in zip(edges, edges[1:])]
    merged = merge_owner_totals(parts[0].unionByName(parts[1]), GAP)
    rest = parts[4].unionByName(parts[2]).unionByName(parts[3])  # any order
    merged = agents_of_owners(merge_owner_totals(merged.unionByName(rest), GAP))
    columns = ("agent_id", "first_seen", "last_seen", "total_sessions", "total_events")
    assert tuples(merged, columns) == tuples(agent_totals(whole), columns)


def test_errors_without_session_keep_their_context(spark):
    rows = [(None, "e0", START, "error"), (None, "e1", START + timedelta(seconds=1), "info"), ("s", "e2", START, "error"), (None, "e3", None, "error")]
    events = spark.createDataFrame(rows, "session_id string, event_id string, ts timestamp, severity string") \
        .withColumns({"tool_name": F.lit("Bash"), "message": F.lit("m")})
    got = errors_with_context(events, 1, 1).select("session_id", "error_id", "position", "event_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        (None, "e0", 0, "e0"), (None, "e0", 1, "e1"), ("s", "e2", 0, "e2"), (None, "e3", -1, "e1"), (None, "e3", 0, "e3")], key=repr)


def test_pages_reach_rows_without_time(spark):
    rows = [(f"e{i}", None if i % 3 == 0 else START - timedelta(seconds=i // 2)) for i in range(20)]
    events, after, seen = spark.createDataFrame(rows, "event_id string, ts timestamp"), None, []
    while True:
        page = newest_first(events, 3, after).collect()
        if not page:
            break
        seen += [r.event_id for r in page]
        after = (page[-1].ts and page[-1].ts.replace(tzinfo=None).astimezone(), page[-1].event_id)
    assert sorted(seen) == sorted(e for e, _ in rows) and len(seen) == len(set(seen))
