"""Joins along time: as-of, interval sums and interval matches.

All of them avoid pairing the rows of a key. Both sides are first reduced to at most one row per key
and day, then laid on one time line per key and read off with a running window. A key that holds a
third of a table therefore costs at most two rows per calendar day in its window, and the work is
linear in the rows. What was read off goes back to the rows by an equi join on key and day, which
spreads a large key over its days and which AQE splits further. Inputs are read once for the line
and once for that join: pass a stored or checkpointed table if their plan is long.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _require_date(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, T.DateType):
        raise TypeError(f"{column} must be a date, is {df.schema[column].dataType.simpleString()}")


def _running(on: Sequence[str], newest_first: bool = False):
    at = F.col("_at").desc() if newest_first else F.col("_at")
    # Rows with a NULL key have no neighbours on a line; dealt by date, they do not meet in one task.
    unknown = F.lit(False)
    for key in on:
        unknown = unknown | F.col(key).isNull()
    apart = F.when(unknown, F.xxhash64("_at"))
    return (
        Window.partitionBy(*on, apart)
        .orderBy(at, "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def read_timeline(
    points: DataFrame,
    history: DataFrame,
    on: Sequence[str],
    point_date: str,
    history_date: str,
    values: Sequence[str],
    direction: str = "backward",
) -> DataFrame:
    """Give every point the nearest non-NULL history value not after it (``forward``: not before).

    Each value column is looked up on its own. Points keep their columns. ``history`` should hold
    one row per key and date; points with a NULL key or date get NULL values.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    marks = history.dropna(subset=[*on, history_date]).select(
        *on, F.col(history_date).alias("_at"), F.lit(0).alias("_kind"), *values
    )
    asked = points.withColumns({"_at": F.col(point_date), "_kind": F.lit(1)})
    line = marks.unionByName(asked, allowMissingColumns=True)
    window = _running(on, newest_first=direction == "forward")
    found = [F.last(v, ignorenulls=True).over(window).alias(v) for v in values]
    keep = [F.col(c) for c in points.columns]
    usable = F.col("_at").isNotNull()
    for key in on:
        usable = usable & F.col(key).isNotNull()
    return (
        line.select(*keep, "_at", "_kind", *found)
        .filter("_kind = 1")
        .select(*keep, *[F.when(usable, F.col(v)).alias(v) for v in values])
    )


def visible_from(feature_time: str, dtype: T.DataType, inclusive: bool) -> Column:
    """First event date that may see a feature stamped ``feature_time``."""
    day = F.col(feature_time).cast("date")
    if not inclusive:
        return F.date_add(day, 1)
    if isinstance(dtype, T.DateType):
        return day
    stamp = F.col(feature_time)
    return F.when(stamp == F.date_trunc("day", stamp), day).otherwise(F.date_add(day, 1))


def asof_join(
    events: DataFrame,
    history: DataFrame,
    on: Sequence[str],
    event_date: str,
    feature_time: str,
    ties: Sequence[str] = (),
    inclusive: bool = False,
    how: str = "inner",
) -> DataFrame:
    """Add to each event the newest history row stamped before its date (or at it: ``inclusive``).

    ``feature_time`` may be a date or a timestamp and is not part of the result. Rows with the same
    time are ordered by ``ties``, then by all other columns. ``how`` is ``inner`` (events without
    history vanish) or ``left``.

    The lookup works on the distinct (key, date) pairs of the events. The final join back is on key
    *and* date with one row per pair on the right, so a key with many events is spread over its
    dates, and AQE may split what is left. The events are read twice; if their plan is long, pass a
    stored or checkpointed table.
    """
    found = asof_lookup(events, history, on, event_date, feature_time, ties, inclusive)
    features = [c for c in history.columns if c not in {*on, feature_time}]
    joined = events.join(found, [*on, event_date], how)
    return joined.select(*events.columns, *features)


def asof_lookup(
    events: DataFrame,
    history: DataFrame,
    on: Sequence[str],
    event_date: str,
    feature_time: str,
    ties: Sequence[str] = (),
    inclusive: bool = False,
) -> DataFrame:
    """The right side of :func:`asof_join`: one row per (key, date) of the events that has history."""
    return asof_lookups(events, [(history, feature_time, ties)], on, event_date, inclusive)


def asof_lookups(
    events: DataFrame,
    histories: Sequence[tuple[DataFrame, str, Sequence[str]]],
    on: Sequence[str],
    event_date: str,
    inclusive: bool = False,
) -> DataFrame:
    """:func:`asof_lookup` in several histories of one key, ``(rows, feature time, ties)`` each.

    The histories lie on one line with the distinct (key, date) pairs of the events, which is sorted
    once and read off for each history apart. Rows have the features of all histories, in their
    order; those of a history that has nothing yet are NULL, pairs without any history are left out.
    """
    _require_date(events, event_date)
    on = list(on)
    marks, features = [], []
    for i, (history, feature_time, ties) in enumerate(histories):
        row = f"_row{i}"
        marks.append(_newest_per_day(history, on, feature_time, list(ties), inclusive, row))
        features += [(row, c) for c in history.columns if c not in {*on, feature_time}]
    rows = [f"_row{i}" for i in range(len(marks))]
    line = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marks)
    dates = events.select(*on, event_date).dropna().distinct()
    return (
        read_timeline(dates, line, on, event_date, "_visible", rows)
        .filter(reduce(or_, [F.col(row).isNotNull() for row in rows]))
        .select(*on, event_date, *[F.col(row)[c].alias(c) for row, c in features])
    )


def _newest_per_day(
    history: DataFrame, on: list[str], feature_time: str, ties: list[str], inclusive: bool, name: str
) -> DataFrame:
    """``on, _visible, name``: the newest row of each key among those seen first from one date on."""
    others = sorted(c for c in history.columns if c not in {*on, feature_time, *ties})
    seen = visible_from(feature_time, history.schema[feature_time].dataType, inclusive)
    # A largest struct is found by sorting. Led by a hash, the sort compares numbers and not keys.
    return (
        history.dropna(subset=[*on, feature_time])
        .groupBy(F.xxhash64(*on, seen).alias("_hash"), *on, seen.alias("_visible"))
        .agg(F.max(F.struct(feature_time, *ties, *others)).alias(name))
        .drop("_hash")
    )


def _known(*columns: str) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known


def next_event(
    sessions: DataFrame, events: DataFrame, on: Sequence[str], start: str, event_date: str,
    name: str = "next_event",
) -> DataFrame:
    """Sessions with the date of the first event of their key on or after their start, or NULL."""
    _require_date(sessions, start)
    on = list(on)
    days = events.select(*on, F.col(event_date).alias(name)).dropna().distinct()
    starts = sessions.select(*on, start).dropna().distinct()
    found = read_timeline(
        starts, days.withColumn("_day", F.col(name)), on, start, "_day", [name], "forward")
    return sessions.join(found.filter(F.col(name).isNotNull()), [*on, start], "left").select(
        *sessions.columns, name)


def sessions_without_event(
    sessions: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    start: str,
    end: str,
    event_date: str,
) -> DataFrame:
    """Sessions ``[start, end]``, both days included, in which no event of their key falls.

    The next event on or after the start decides, so no session meets more than one event.
    """
    looked_up = next_event(sessions, events, on, start, event_date, "_next")
    return looked_up.filter(
        F.col("_next").isNull() | (F.col("_next") > F.col(end)) | F.col(end).isNull()
    ).select(*sessions.columns)


def events_and_free_sessions(
    sessions: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    start: str,
    end: str,
    event_date: str,
    amounts: Sequence[str],
) -> DataFrame:
    """All events, and as rows of zeros the sessions of :func:`sessions_without_event`.

    Events are not shuffled but for their distinct days. The date column is called ``start``.
    """
    free = sessions_without_event(
        sessions.select(*on, start, end), events, on, start, end, event_date)
    zeros = [F.lit(0).cast(events.schema[a].dataType).alias(a) for a in amounts]
    return events.select(*on, F.col(event_date).alias(start), *amounts).unionByName(
        free.select(*on, start, *zeros))


def session_sums(
    sessions: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    start: str,
    end: str,
    event_date: str,
    amounts: Sequence[str],
) -> DataFrame:
    """Per session the sum of each amount over its events in ``[start, end]``, 0 when there are none.

    Running totals per key and day are read at the end and just before the start; their difference
    is the sum. Amounts should be decimals, for which that difference is exact. Equal sessions are
    merged.
    """
    _require_date(sessions, start)
    on = list(on)
    totals = [f"_sum_{a}" for a in amounts]
    daily = (
        events.dropna(subset=[*on, event_date])
        .groupBy(*on, F.col(event_date).alias("_at"))
        .agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(t) for a, t in zip(amounts, totals)])
        .withColumn("_kind", F.lit(0))
    )
    edges = F.array(
        F.struct(F.date_sub(F.col(start), 1).alias("_at"), F.lit(-1).alias("_sign")),
        F.struct(F.col(end).alias("_at"), F.lit(1).alias("_sign")),
    )
    known = _known(*on, start, end) & (F.col(start) <= F.col(end))
    asked = sessions.select("*", F.inline(edges)).withColumn(
        "_at", F.when(known, F.col("_at")))
    days = asked.select(*on, "_at").dropna().distinct().withColumn("_kind", F.lit(1))
    window = _running(on)
    running = [F.sum(F.coalesce(t, F.lit(0))).over(window).alias(t) for t in totals]
    read = daily.unionByName(days, allowMissingColumns=True).select(
        *on, "_at", "_kind", *running).filter("_kind = 1").drop("_kind")
    return asked.join(read, [*on, "_at"], "left").groupBy(*sessions.columns).agg(*[
        F.coalesce(F.sum(F.col(t) * F.col("_sign")), F.lit(0)).alias(a)
        for a, t in zip(amounts, totals)
    ])


def match_sessions(
    sessions: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    start: str,
    end: str,
    event_date: str,
    amounts: Sequence[str],
) -> DataFrame:
    """Sessions with ``hits``, an array of (date, amounts) of the days with events in them.

    The array is in time order, sums the amounts of a day, and is empty for a session without an
    event. It has at most one entry per day of the session. Sessions are cut at month borders and
    joined on key and month, so a session only meets the at most 31 event days of its own months.
    Only months from the first to the last event are listed: a session that ends in the year 9999
    costs as many pieces as the events have months. Equal sessions are merged.
    """
    on = list(on)
    daily = (
        events.dropna(subset=[*on, event_date])
        .groupBy(*on, event_date)
        .agg(*[F.sum(a).alias(a) for a in amounts])
        .withColumn("_month", F.trunc(event_date, "month"))
    )
    # one pass for both ends, over the days alone
    days_known = events.dropna(subset=[*on, event_date])
    span = days_known.agg(F.struct(
        F.trunc(F.min(event_date), "month").alias("low"),
        F.trunc(F.max(event_date), "month").alias("high")).alias("span")).scalar()
    cut = sessions.withColumn("_span", span).withColumns({
        "_first": F.greatest(F.trunc(start, "month"), F.col("_span.low")),
        "_last": F.least(F.trunc(end, "month"), F.col("_span.high")),
    }).drop("_span")
    first, last = F.col("_first"), F.col("_last")
    months = F.when(
        (F.col(start) <= F.col(end)) & (first <= last),
        F.sequence(first, F.greatest(first, last), F.expr("interval 1 month")),
    )
    pieces = cut.select("*", F.explode_outer(months).alias("_month")).alias("s")
    days = daily.alias("d")
    same = F.col(f"d.{event_date}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))
    for key in (*on, "_month"):
        same = same & (F.col(f"s.{key}") == F.col(f"d.{key}"))
    hit = F.when(
        F.col(f"d.{event_date}").isNotNull(),
        F.struct(F.col(f"d.{event_date}"), *[F.col(f"d.{a}") for a in amounts]),
    )
    return (
        pieces.join(days, same, "left")
        .select(*[F.col(f"s.{c}") for c in sessions.columns], hit.alias("_hit"))
        .groupBy(*sessions.columns)
        .agg(F.sort_array(F.collect_list("_hit")).alias("hits"))
    )
