"""Session operators against a plain Python replay of the events."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracewell.operators.ordering import number_rows
from tracewell.operators.sessions import attach_sessions, closes_of, idle_sessions, session_ordinal, session_rollup, sessionize

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
TIMEOUT = timedelta(minutes=30)


def make_events(seed, n=400, agents=3):
    """Few owners; one of them holds a third of the rows and more."""
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(n):
        owner = ("hot", "t") if rng.random() < 0.4 else (f"a{rng.randrange(agents)}", rng.choice("tu"))
        step = rng.choice([0, 1, 60, 600, 1800, 1800.000001, 1801, 5400, 90_000])
        clock[owner] = clock.get(owner, START) + timedelta(seconds=step)
        rows.append((f"e{i:04d}", *owner, clock[owner], f'{{"project_dir":"p{i % 3}","git_branch":""}}'))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id string, agent_id string, session_token string, ts timestamp, context string").repartition(3)


def replay(rows, closes=()):
    """Sessions as lists of events, by owner, closing on idle time or on request."""
    sessions = []
    for owner in sorted({r[1:3] for r in rows}):
        current, last = None, None
        for event in sorted((r for r in rows if r[1:3] == owner), key=lambda r: (r[3], r[0])):
            ended = current is None or event[3] - last > TIMEOUT or any(c[:2] == owner and last <= c[2] < event[3] for c in closes)
            if ended:
                current = []
                sessions.append((owner, current))
            current.append(event)
            last = event[3]
    return sessions


def grouped(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.session_id, set()).add(r.event_id)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", range(3))
def test_sessionize(spark, seed):
    rows = make_events(seed)
    expected = sorted(sorted(e[0] for e in s) for _, s in replay(rows))
    assert grouped(sessionize(frame(spark, rows), TIMEOUT)) == expected


def make_closes(rows, seed):
    rng = random.Random(seed)
    closes = [(*r[1:3], r[3] + timedelta(seconds=rng.choice([-0.5, 0, 0.5, 30, 1900]))) for r in rng.sample(rows, 60)]
    return closes + closes[:5]


def close_frame(spark, closes):
    return spark.createDataFrame(closes, "agent_id string, session_token string, closed_at timestamp")


@pytest.mark.parametrize("seed", range(3))
def test_closes(spark, seed):
    rows = make_events(seed)
    closes = make_closes(rows, seed)
    found = sessionize(frame(spark, rows), TIMEOUT, close_frame(spark, closes))
    assert found.count() == len(rows)
    assert grouped(found) == sorted(sorted(e[0] for e in s) for _, s in replay(rows, closes))


@pytest.mark.parametrize("with_closes", [False, True])
def test_rollup(spark, with_closes):
    rows = make_events(5)
    closes = make_closes(rows, 5) if with_closes else []
    as_of = max(r[3] for r in rows) - timedelta(minutes=5)
    given = close_frame(spark, closes) if closes else None
    rolled = session_rollup(frame(spark, rows), F.lit(as_of), TIMEOUT, given)
    got = sorted((r.agent_id, r.session_token, r.started_at, r.last_event_at, r.event_count, r.status, r.ended_at, r.project_dir)
                 for r in rolled.collect())
    expected = []
    for owner, s in replay(rows, closes):
        last = s[-1][3]
        after = sorted(c[2] for c in closes if c[:2] == owner and c[2] >= last)
        done = bool(after) and after[0] <= last + TIMEOUT and after[0] <= as_of
        late = last + TIMEOUT < as_of
        ended = after[0] if done else last + TIMEOUT if late else None
        status = "completed" if done else "timed_out" if late else "active"
        naive = [t and t.replace(tzinfo=None) for t in (s[0][3], last, ended)]
        expected.append((*owner, naive[0], naive[1], len(s), status, naive[2], s[0][4][16:18]))
    assert got == sorted(expected)


def test_ids_do_not_depend_on_partitioning(spark):
    rows = make_events(9)
    first = sessionize(frame(spark, rows), TIMEOUT).select("event_id", "session_id").orderBy("event_id").collect()
    again = sessionize(frame(spark, rows).repartition(7, "ts"), TIMEOUT).select("event_id", "session_id").orderBy("event_id").collect()
    assert first == again


def test_stored_sessions_attach_alike(spark):
    rows = make_events(2)
    events = frame(spark, rows)
    sessions = session_rollup(events, F.lit(START), TIMEOUT)
    attached = attach_sessions(events, sessions).select("event_id", "session_id")
    direct = sessionize(events, TIMEOUT).select("event_id", "session_id")
    assert sorted(attached.collect()) == sorted(direct.collect())


def test_closes_of(spark):
    rows = make_events(3, n=50)
    events = frame(spark, rows)
    sessions = session_rollup(events, F.lit(START), TIMEOUT)
    requests = sessions.select("session_id", F.col("started_at").alias("closed_at"))
    split = sessionize(events, TIMEOUT, closes_of(sessions, requests))
    closes = [(*owner, s[0][3]) for owner, s in replay(rows)]
    assert grouped(split) == sorted(sorted(e[0] for e in s) for _, s in replay(rows, closes))


def test_idle(spark):
    rows = make_events(4)
    end = max(r[3] for r in rows)
    sessions = session_rollup(frame(spark, rows), F.lit(end), timedelta(days=365))
    got = {(r.agent_id, r.session_token) for r in idle_sessions(sessions, F.lit(end), TIMEOUT).collect()}
    last = {}
    for r in rows:
        last[r[1:3]] = max(r[3], last.get(r[1:3], START))
    assert got == {o for o, t in last.items() if t < end - TIMEOUT}


def test_ordinals(spark):
    rows = make_events(6)
    sessions = session_rollup(frame(spark, rows), F.lit(START), TIMEOUT)
    for agent in {r[1] for r in rows}:
        mine = session_ordinal(sessions).where(F.col("agent_id") == agent).orderBy("started_at", "session_id").collect()
        assert [r.ordinal for r in mine] == list(range(1, len(mine) + 1))


def test_number_rows_with_nulls_and_ties(spark):
    rows = [(g, START + timedelta(seconds=i // 3 * 45), f"id{i % 50:03d}-{g}") for g in ("a", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, ts timestamp, id string").withColumn("id", F.concat("id", F.monotonically_increasing_id()))
    got = number_rows(df, ["g"], "ts", "id", "n").collect()
    assert len(got) == 400
    for g in ("a", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.ts, r.id))
        assert [r.n for r in mine] == list(range(1, 201))


def test_incomplete_events_are_kept(spark):
    rows = [("e1", "a", "t", START, "{}"), ("e2", None, "t", START, "{}"), ("e3", "a", None, START, "{}"), ("e4", "a", "t", None, "{}")]
    got = {r.event_id: r.session_id is not None for r in sessionize(frame(spark, rows)).collect()}
    assert got == {"e1": True, "e2": False, "e3": False, "e4": False}
    assert session_rollup(frame(spark, rows), F.lit(START)).count() == 1
