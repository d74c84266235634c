"""Sessions: assignment of events, rollup, idle detection.

An event joins the active session of its agent and token; a gap longer than the
timeout, or an explicit close, ends it. Time is cut into slots as wide as the
timeout, so a gap that ends a session can only lie between slots: sessions
follow from the first and last event of each slot. Events are therefore never
sorted, and an agent with a large share of all events is spread over its slots.
What meets per agent and token is one row per slot, bounded by the time span.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordering import number_rows, time_slice

DEFAULT_TIMEOUT = timedelta(minutes=30)
OWNER = ["agent_id", "session_token"]
#: Cells of the range join: 2^32 microseconds at level 0, 16 times as long at each further one, longer than all time at the last.
CELL_BITS, LEVEL_BITS, LEVELS = 32, 4, 8
_SLOT = [*OWNER, "_slot", "_cut"]


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def session_id(agent: Column, token: Column, started_us: Column) -> Column:
    """Id derived from the session's first event, equal on every run."""
    return F.sha2(F.concat_ws("|", agent, token, started_us.cast("string")), 256)


def _close_times(closes: DataFrame, timeout: timedelta) -> DataFrame:
    return closes.select(
        *OWNER, F.unix_micros("closed_at").alias("_closed"), time_slice(F.col("closed_at"), _micros(timeout)).alias("_slot"),
    ).distinct()


def _slotted(events: DataFrame, timeout: timedelta, closes: DataFrame | None) -> DataFrame:
    """Add the slot and, inside a slot, how many closes came before the event."""
    slotted = events.withColumn("_slot", time_slice(F.col("ts"), _micros(timeout)))
    if closes is None:
        return slotted.withColumn("_cut", F.lit(0))
    times = _close_times(closes, timeout)
    order = Window.partitionBy(*OWNER, "_slot").orderBy("_closed")
    nth = F.row_number().over(order)
    # Close i bounds the piece (close i-1, close i]; the last one opens another.
    pieces = F.when(F.lead("_closed").over(order).isNull(), F.array(nth - 1, nth)).otherwise(F.array(nth - 1))
    bounded = times.select(*OWNER, "_slot", "_closed", nth.alias("_nth"), F.lag("_closed").over(order).alias("_previous"),
                           pieces.alias("_pieces"))
    ranges = bounded.select(*OWNER, "_slot", "_closed", "_nth", "_previous", F.explode("_pieces").alias("_cut")).select(
        *OWNER, "_slot", "_cut",
        F.when(F.col("_cut") == F.col("_nth"), F.col("_closed")).otherwise(F.col("_previous")).alias("_low"),
        F.when(F.col("_cut") < F.col("_nth"), F.col("_closed")).alias("_high"))
    e, r, us = slotted.alias("e"), ranges.alias("r"), F.unix_micros("e.ts")
    same = F.lit(True)
    for c in (*OWNER, "_slot"):
        same = same & (F.col(f"e.{c}") == F.col(f"r.{c}"))
    inside = (F.col("r._low").isNull() | (us > F.col("r._low"))) & (F.col("r._high").isNull() | (us <= F.col("r._high")))
    return e.join(r, same & inside, "left").select("e.*", F.coalesce(F.col("r._cut"), F.lit(0)).alias("_cut"))


def _segments(slotted: DataFrame, timeout: timedelta, closes: DataFrame | None, extra: list[Column],
              carried: DataFrame | None = None) -> DataFrame:
    """One row per slot piece, with the start of its session and the next close.

    ``carried`` has open sessions of earlier events as pieces.
    """
    us = F.unix_micros("ts")
    complete = F.col("_slot").isNotNull() & F.col("agent_id").isNotNull() & F.col("session_token").isNotNull()
    pieces = slotted.where(complete).groupBy(*_SLOT).agg(
        F.min(us).alias("_first"), F.max(us).alias("_last"), F.count(F.lit(1)).alias("_n"), *extra)
    if carried is not None:
        pieces = pieces.unionByName(carried, allowMissingColumns=True)
    if closes is not None:
        marks = _close_times(closes, timeout).select(*OWNER, F.col("_closed"), F.col("_closed").alias("_first"))
        pieces = pieces.withColumn("_closed", F.lit(None).cast("bigint")).unionByName(marks, allowMissingColumns=True)
    else:
        pieces = pieces.withColumn("_closed", F.lit(None).cast("bigint"))
    # At the same instant the event belongs to the session that then closes.
    order = Window.partitionBy(*OWNER).orderBy("_first", F.col("_closed").isNotNull())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    previous = F.max("_last").over(earlier)
    last_close = F.max("_closed").over(earlier)
    starts = previous.isNull() | (F.col("_first") - previous > _micros(timeout)) | F.coalesce(last_close >= previous, F.lit(False))
    marked = pieces.withColumns({
        "_start": F.col("_closed").isNull() & starts,
        "_next_close": F.min("_closed").over(later),
    })
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumns({
        "session_seq": F.sum(F.col("_start").cast("bigint")).over(running),
        "_started": F.max(F.when(F.col("_start"), F.col("_first"))).over(running),
    }).where(F.col("_closed").isNull())
    return numbered.withColumn("session_id", session_id(F.col("agent_id"), F.col("session_token"), F.col("_started")))


def sessionize(events: DataFrame, timeout: timedelta = DEFAULT_TIMEOUT, closes: DataFrame | None = None) -> DataFrame:
    """Add ``session_id``, ``session_seq`` and ``session_started_at`` to events.

    ``closes`` has ``agent_id, session_token, closed_at``; an event after a
    close starts a new session, one at the same instant still belongs to the old.
    An event without agent, token or time is kept with a NULL session.
    """
    slotted = _slotted(events, timeout, closes)
    found = _segments(slotted, timeout, closes, []).select(
        *_SLOT, "session_id", "session_seq", F.timestamp_micros("_started").alias("session_started_at"))
    names = [c for c in events.columns if c not in ("session_id", "session_seq", "session_started_at")]
    return slotted.select(*names, "_slot", "_cut").join(found, _SLOT, "left") \
        .select(*names, "session_id", "session_seq", "session_started_at")


def merged_sessions(events: DataFrame, timeout: timedelta, closes: DataFrame | None, carried: DataFrame | None = None) -> DataFrame:
    """Sessions with start and last event in microseconds, count, origin and next close (``_started, _last, event_count, _origin, _close``)."""
    context = F.col("context")
    origin = F.min_by(
        F.struct(F.get_json_object(context, "$.project_dir").alias("project_dir"),
                 F.get_json_object(context, "$.git_branch").alias("git_branch")),
        F.struct("ts", "event_id")).alias("_origin")
    segments = _segments(_slotted(events, timeout, closes), timeout, closes, [origin], carried)
    return segments.groupBy("session_id", *OWNER, "session_seq", F.col("_started")).agg(
        F.max("_last").alias("_last"), F.sum("_n").alias("event_count"),
        F.min_by("_origin", "_first").alias("_origin"), F.max_by("_next_close", "_last").alias("_close"))


def session_rollup(events: DataFrame, as_of: Column, timeout: timedelta = DEFAULT_TIMEOUT,
                   closes: DataFrame | None = None, pins: DataFrame | None = None) -> DataFrame:
    """One row per session. ``pins`` lists pinned ``session_id`` values.

    Project and branch are those of the creating event. A session closed before
    it went idle is ``completed``; else, once idle for longer than the timeout at
    ``as_of``, ``timed_out``; else ``active``.
    """
    sessions = merged_sessions(events.select("event_id", *OWNER, "ts", "context"), timeout, closes)
    idle_at = F.col("_last") + _micros(timeout)
    now = F.unix_micros(as_of)
    closed = (F.col("_close") <= idle_at) & (F.col("_close") <= now)
    timed_out = idle_at < now
    pinned = F.lit(False)
    if pins is not None:
        sessions = sessions.join(pins.select("session_id", F.lit(True).alias("_pin")).distinct(), "session_id", "left")
        pinned = F.coalesce(F.col("_pin"), F.lit(False))
    return sessions.select(
        "session_id", "session_token", "agent_id", "session_seq",
        F.when(closed, "completed").when(timed_out, "timed_out").otherwise("active").alias("status"),
        F.col("_origin.project_dir").alias("project_dir"), F.col("_origin.git_branch").alias("git_branch"),
        F.timestamp_micros("_started").alias("started_at"),
        F.timestamp_micros(F.when(closed, F.col("_close")).when(timed_out, idle_at)).alias("ended_at"),
        F.timestamp_micros("_last").alias("last_event_at"), "event_count", pinned.alias("pinned"),
    )


def closes_of(sessions: DataFrame, closed: DataFrame) -> DataFrame:
    """Close requests ``session_id, closed_at`` as ``closes`` for ``sessionize``."""
    return closed.join(sessions.select("session_id", *OWNER), "session_id").select(*OWNER, "closed_at")


def attach_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Give events the stored session of their agent and token that spans them."""
    bounds = sessions.select(*OWNER, "session_id", F.col("started_at").alias("_from"), F.col("last_event_at").alias("_to"))
    names = [c for c in events.columns if c != "session_id"]
    return _within(events.select(*names), bounds)


def _cells_of(bounds: DataFrame) -> DataFrame:
    """Each interval with the one or two cells that cover it, at the first level whose cells are as long as it is.

    A cell is 2^32 microseconds, a little over an hour, sixteen times as long at every further level.
    """
    micros = bounds.withColumns({"_first": F.unix_micros("_from"), "_end": F.unix_micros("_to")}).where("_first <= _end")
    over = F.shiftright(F.col("_end") - F.col("_first") - 1, CELL_BITS)
    level = F.when(over <= 0, 0).otherwise(F.ceil(F.length(F.bin(over)) / LEVEL_BITS)).cast("int")
    cells = F.expr(f"sequence(shiftright(_first, {CELL_BITS} + {LEVEL_BITS} * _level), shiftright(_end, {CELL_BITS} + {LEVEL_BITS} * _level))")
    return micros.withColumn("_level", level).withColumn("_cell", F.explode(cells))


def _within(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Range join through nested cells of time: events are never repeated, intervals only for cells that hold events.

    The cells that hold events of an owner look up the intervals that touch
    them, one cell a level; a long interval is two rows until then. Events then
    meet the intervals of their cell, so an owner with a third of all events is
    spread over its cells, and a cell that is still large can be split.
    """
    placed = events.withColumn("_cell", F.shiftright(F.unix_micros("ts"), CELL_BITS))
    held = placed.select(*OWNER, F.col("_cell").alias("_held")).dropna().distinct() \
        .withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))) \
        .withColumn("_cell", F.expr(f"shiftright(_held, {LEVEL_BITS} * _level)"))
    touching = held.join(_cells_of(bounds), [*OWNER, "_level", "_cell"]) \
        .where((F.shiftright("_first", CELL_BITS) <= F.col("_held")) & (F.shiftright("_end", CELL_BITS) >= F.col("_held"))) \
        .select(*OWNER, F.col("_held").alias("_cell"), "_from", "_to", "session_id")
    inside = (F.col("e.ts") >= F.col("s._from")) & (F.col("e.ts") <= F.col("s._to"))
    same = F.col("e._cell") == F.col("s._cell")
    for c in OWNER:
        same = same & (F.col(f"e.{c}") == F.col(f"s.{c}"))
    return placed.alias("e").join(touching.alias("s"), same & inside, "left") \
        .select(*[F.col(f"e.{c}") for c in events.columns], F.col("s.session_id").alias("session_id"))


def idle_sessions(sessions: DataFrame, as_of: Column, timeout: timedelta = DEFAULT_TIMEOUT) -> DataFrame:
    """Active sessions whose last event is older than the timeout at ``as_of``."""
    cutoff = F.unix_micros(as_of) - _micros(timeout)
    return sessions.where((F.col("status") == "active") & (F.unix_micros("last_event_at") < cutoff))


def session_ordinal(sessions: DataFrame) -> DataFrame:
    """Number the sessions of each agent by start."""
    return number_rows(sessions, ["agent_id"], "started_at", "session_id", "ordinal", slice_seconds=3600)
