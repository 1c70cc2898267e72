"""Snapshots at month ends and sums over windows that reach back from them.

Facts are never range-joined with ids x month ends. A snapshot calendar is a rule, so each claim or
session can name the months whose windows may hold it. Losses, whose bins differ with every month,
are exploded over them, but after all shuffles. Exposures change a running total at the first and
after the last of them. The calendar is joined last: it has one row per month end, so its size is
known before it is broadcast.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions.dates import months_back
from hindcast.functions.types import as_column

# Fixed values: (nearer, farther) edge in months of the exposure windows.
EXPOSURE_WINDOWS = (
    (0, 6), (0, 12), (0, 24), (0, 36), (0, 48), (12, 24), (24, 36), (36, 48),
)
DEFAULT_RETRO_MONTHS = 24


@dataclass(frozen=True)
class MonthEnds:
    """All month ends from ``first`` to ``last``, given as ISO dates."""

    first: str
    last: str

    def _span(self) -> tuple[int, int]:
        first, last = (datetime.date.fromisoformat(d) for d in (self.first, self.last))
        return first.year * 12 + first.month, last.year * 12 + last.month

    def table(self, spark: SparkSession, edges: Sequence[int] = ()) -> DataFrame:
        """``_month, dt`` and one ``_back_<n>`` per edge: the date n months before ``dt``."""
        low, high = self._span()
        start = F.trunc(F.to_date(F.lit(self.first)), "month")
        ends = spark.range(high - low + 1).select(
            (F.col("id") + low).cast("int").alias("_month"),
            F.last_day(F.add_months(start, F.col("id").cast("int"))).alias("dt"),
        )
        inside = F.col("dt").between(F.lit(self.first), F.lit(self.last))
        return ends.filter(inside).select(
            "*", *[months_back("dt", n).alias(f"_back_{n}") for n in sorted(set(edges))]
        )

    def months_between(self, start: Column | str, end: Column | str) -> Column:
        """Month numbers of the calendar from the month of ``start`` to that of ``end``."""
        return self.numbers_between(month_number(start), month_number(end))

    def numbers_between(self, first: Column, last: Column) -> Column:
        """The month numbers from ``first`` to ``last`` that the calendar has; NULL for none."""
        low, high = self._span()
        first, last = F.greatest(first, F.lit(low)), F.least(last, F.lit(high))
        return F.when(first <= last, F.sequence(first, last))


def month_number(date: Column | str) -> Column:
    """Months since year 0, the number behind the calendar's ``_month``."""
    date = as_column(date)
    return F.year(date) * 12 + F.month(date)


def month_end_until(date: Column | str) -> Column:
    """The newest month end not after ``date``: all days with the same one see the same snapshots."""
    return F.last_day(F.add_months(F.date_add(as_column(date), 1), -1))


def snapshot_grid(ids: DataFrame, id_column: str, calendar: MonthEnds) -> DataFrame:
    """Distinct ids x month ends."""
    every = calendar.months_between(
        F.lit(calendar.first).cast("date"), F.lit(calendar.last).cast("date")
    )
    months = ids.select(id_column).distinct().withColumn("_month", F.explode(every))
    return months.join(F.broadcast(calendar.table(ids.sparkSession)), "_month").select(
        id_column, "dt"
    )


def retro_losses(
    claims: DataFrame,
    id_column: str,
    calendar: MonthEnds,
    coverages: Sequence[str],
    retro_months: int = DEFAULT_RETRO_MONTHS,
) -> DataFrame:
    """Losses per id, coverage and snapshot ``dt`` in monthly bins reaching back from it.

    ``claims`` holds ``int_claim_num, cvg, loss_dt, loss_sum`` and the id; a claim listed several
    times with the same date and amount counts once per id. Bin ``m`` is
    ``[dt - (m+1) months, dt - m months)``. Result: ``id, cvg, dt, bins, acum`` with two arrays of
    whole numbers of ``retro_months + 1`` entries; ``acum[m]`` sums bins 0..m, which is exact because the bins lie
    end to end and money is decimal. Only then are both cut to whole units. Rows without a positive
    entry are left out.
    """
    daily = (
        claims.filter(F.col("cvg").isin(*coverages))
        .select(id_column, "cvg", "int_claim_num", "loss_dt", "loss_sum")
        .dropna(subset=[id_column, "loss_dt"])
        .distinct()
        .groupBy(id_column, "cvg", "loss_dt")
        .agg(F.sum("loss_sum").alias("loss"))
    )
    # a month end taken back to the month of the loss falls on its own day, or on that month's last:
    # days before the 28th are on the same side of every month end
    day = F.dayofmonth("loss_dt")
    reach = calendar.numbers_between(F.col("_loss_month"), F.col("_loss_month") + retro_months + 1)
    # Few rows per id and month are dealt by id and coverage. All that follows stays in the task, so
    # the wide rows per snapshot are never shuffled; the calendar bounds what an id brings there.
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    monthly = (
        daily.select(
            id_column, "cvg",
            (F.col("loss") * 100).cast("bigint").alias("_cents"),
            month_number("loss_dt").alias("_loss_month"),
            F.greatest(day, F.lit(27)).alias("_day"),
            F.dayofmonth(F.last_day("loss_dt")).alias("_days_in_month"),
        )
        .filter(reach.isNotNull())
        .repartition(parts, id_column, "cvg")
        .groupBy(id_column, "cvg", "_loss_month", "_day", "_days_in_month")
        .agg(F.sum("_cents").alias("_cents"))
    )
    dated = monthly.withColumn("_month", F.explode(reach))
    edge = F.least(F.dayofmonth("dt"), F.col("_days_in_month"))
    reached = (F.col("_day") >= edge).cast("int")
    binned = dated.join(F.broadcast(calendar.table(claims.sparkSession)), "_month").withColumn(
        "_bin", F.col("_month") - F.col("_loss_month") - reached
    )
    months = range(retro_months + 1)
    sums = (
        binned.filter(F.col("_bin").between(0, retro_months))
        .groupBy(id_column, "cvg", "dt")
        .agg(*[F.expr(f"sum(if(_bin = {m}, _cents, 0L)) as _b{m}") for m in months],
             *[F.expr(f"sum(if(_bin <= {m}, _cents, 0L)) as _a{m}") for m in months])
    )
    # Generated code throughout: a function over an array would be interpreted for every row, running
    # sums in one projection would repeat each other and outgrow what is compiled.
    cents = [*[f"_b{m}" for m in months], *[f"_a{m}" for m in months]]

    def whole_units(prefix: str) -> Column:
        return F.array(*[F.expr(f"{prefix}{m} div 100") for m in months])

    return sums.filter(F.greatest(*cents) >= 100).select(  # a whole unit in some bin or total
        id_column, "cvg", "dt", whole_units("_b").alias("bins"), whole_units("_a").alias("acum"))


def retro_losses_long(stored: DataFrame, id_column: str, kind: str) -> DataFrame:
    """One row per positive entry of ``bins`` or ``acum``: ``id, cvg, dt, months_back, loss``."""
    return stored.select(
        id_column, "cvg", "dt", F.posexplode(kind).alias("months_back", "loss")
    ).filter("loss > 0")


def retro_exposures(
    sessions: DataFrame,
    id_column: str,
    others: Sequence[str],
    calendar: MonthEnds,
    windows: Sequence[tuple[int, int]] = EXPOSURE_WINDOWS,
) -> DataFrame:
    """Premium and exposure figures per id, snapshot and window, over sessions wholly inside it.

    Window ``(near, far)`` is ``[dt - far months, dt - near months)``. Figures, cut to whole units:
    sum, mean and sample variance of ``session_prem``; mean and variance of ``ver_days``; distinct
    counts of the two ``others``, ``term_eff`` and ``ver_eff``. A variance over one session is 0.

    The snapshots whose window ``(near, far)`` holds a session run from a month that its end and
    ``near`` give to one that its start and ``far`` give. So a session, or a value's sessions, adds
    its figures at the first of them and takes them back after the last; running totals over the
    months that something happens in give all snapshots. No row is repeated per month before it is
    summed per id, window and month.

    A value counts once while any of its sessions is held. In the order of their ends the runs of
    months begin in order too, so each adds what lies after the furthest run before it. Of sessions
    of a value with one end the latest start decides, so a value has at most one row per day. Store or
    checkpoint ``sessions`` first: they are read twice.
    """
    eff, exp = F.col("ver_eff"), F.col("ver_exp")
    low, high = calendar._span()
    nears, fars = (sorted({w[i] for w in windows}) for i in (0, 1))

    def reaches(date: Column, months: int) -> tuple[Column, Column]:
        """The month so much after ``date``, and its end taken back again."""
        end = F.last_day(F.add_months(F.trunc(date, "month"), months))
        return month_number(end), months_back(end, months)

    def first_month(near: int) -> Column:
        month, back = reaches(exp, near)
        return F.greatest(month + F.when(back > exp, 0).otherwise(1), F.lit(low))

    def last_month(far: int) -> Column:
        month, back = reaches(eff, far)
        return F.least(month - F.when(back <= eff, 0).otherwise(1), F.lit(high))

    def edges(df: DataFrame, figures: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        """Per window the month in which the figures come and the one in which they go."""
        ends = F.array(*[
            F.struct(F.lit(i).alias("_window"), F.col(f"_first_{near}").alias("_from"),
                     F.col(f"_last_{far}").alias("_to"),
                     *([F.col(f"_seen_{far}").alias("_seen")] if f"_seen_{far}" in df.columns
                       else [F.lit(None).cast("int").alias("_seen")]))
            for i, (near, far) in enumerate(windows)
        ])
        start = F.greatest(F.col("_from"), F.col("_seen") + 1)
        held = df.select(id_column, *keep, *figures, F.inline(ends)).withColumn(
            "_from", start).filter("_from <= _to")
        come = F.struct(F.col("_from").alias("_month"), F.lit(True).alias("_comes"))
        go = F.struct((F.col("_to") + 1).alias("_month"), F.lit(False).alias("_comes"))
        signed = [F.when(F.col("_comes"), F.col(c)).otherwise(-F.col(c)).alias(c) for c in figures]
        return held.select(id_column, "_window", *keep, *figures, F.inline(F.array(come, go))).select(
            id_column, "_window", "_month", *keep, *signed)

    def with_months(df: DataFrame) -> DataFrame:
        return df.withColumns({
            **{f"_first_{near}": first_month(near) for near in nears},
            **{f"_last_{far}": last_month(far) for far in fars}})

    known = sessions.dropna(subset=[id_column, "ver_eff", "ver_exp"])
    figures = ("_k", "_n_c", "_s_c", "_q_c", "_n_d", "_s_d", "_q_d")
    cents = (F.col("session_prem").cast("decimal(18,2)") * 100).cast("long")
    square = cents.cast("decimal(18,0)") * cents.cast("decimal(18,0)")
    days = F.col("ver_days").cast("long")
    zero = F.lit(0).cast("long")
    by_dates = known.groupBy(id_column, "ver_eff", "ver_exp").agg(
        F.count(F.lit(1)).alias("_k"),
        F.count(cents).alias("_n_c"),
        F.coalesce(F.sum(cents), zero).alias("_s_c"),
        F.coalesce(F.sum(square), F.lit(0).cast("decimal(38,0)")).alias("_q_c"),
        F.count(days).alias("_n_d"),
        F.coalesce(F.sum(days), zero).alias("_s_d"),
        F.coalesce(F.sum(days * days), zero).alias("_q_d"),
    )
    numbers = edges(with_months(by_dates), figures).groupBy(id_column, "_window", "_month").agg(
        *[F.sum(c).alias(c) for c in figures])
    dims = [*others, "term_eff", "ver_eff"]
    values = F.array(
        *[
            F.struct(F.lit(i).alias("_dim"), F.col(d).cast("string").alias("_value"))
            for i, d in enumerate(dims)
        ]
    )
    by_value = (
        known.select(id_column, "ver_eff", "ver_exp", F.inline(values))
        .filter("_value is not null")
        .groupBy(id_column, "_dim", "_value", "ver_exp")
        .agg(F.max("ver_eff").alias("ver_eff"))
    )
    earlier = (
        Window.partitionBy(id_column, "_dim", "_value").orderBy("ver_exp")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = with_months(by_value)
    placed = placed.withColumns({f"_seen_{far}": F.max(f"_last_{far}").over(earlier) for far in fars})
    counted = edges(placed.withColumn("_values", F.lit(1).cast("long")), ["_values"], ["_dim"])
    names = [f"cntdist_{d}" for d in dims]
    counts = counted.groupBy(id_column, "_window", "_month").agg(
        *[F.sum(F.when(F.col("_dim") == i, F.col("_values"))).alias(c) for i, c in enumerate(names)])
    totals = [*figures, *names]
    # Windows here hold one id and window: at most two rows per month of the calendar.
    in_order = Window.partitionBy(id_column, "_window").orderBy("_month")
    changes = numbers.unionByName(counts, allowMissingColumns=True).groupBy(
        id_column, "_window", "_month").agg(*[F.sum(c).alias(c) for c in totals])
    running = changes.select(
        id_column, "_window", "_month", F.lead("_month").over(in_order).alias("_next"),
        *[F.sum(c).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c)
          for c in totals],
    )
    snapshots = (
        running.filter("_k > 0")
        .withColumn("_month", F.explode(F.sequence("_month", F.col("_next") - 1)))
        .join(F.broadcast(calendar.table(sessions.sparkSession)), "_month")
    )

    def variance(n: str, s: str, q: str, scale: int) -> Column:
        """(n * sum of squares - square of sum) / (n * (n - 1)), in whole numbers up to the end."""
        n, s, q = F.col(n).cast("decimal(12,0)"), F.col(s).cast("decimal(19,0)"), F.col(q)
        spread = n * q.cast("decimal(26,0)") - s * s
        pairs = (n * (n - 1) * F.lit(scale)).cast("decimal(30,0)")
        return F.coalesce(F.try_divide(spread, pairs).cast("long"), F.lit(0).cast("long"))

    def whole(c: Column) -> Column:
        return F.coalesce(c.cast("long"), F.lit(0).cast("long"))

    windows_dim = F.array(
        *[F.struct(F.lit(near).alias("near"), F.lit(far).alias("far")) for near, far in windows]
    )
    return (
        snapshots.withColumn("_edges", F.get(windows_dim, F.col("_window")))
        .select(
            id_column, "dt",
            F.col("_edges.near").alias("near_months"), F.col("_edges.far").alias("far_months"),
            whole(F.col("_s_c").cast("decimal(24,0)") / 100).alias("prem_sum"),
            variance("_n_c", "_s_c", "_q_c", 10000).alias("prem_var"),
            whole(F.try_divide(F.col("_s_c").cast("decimal(24,0)"),
                               F.col("_n_c").cast("decimal(12,0)") * 100)).alias("prem_mean"),
            whole(F.try_divide(F.col("_s_d").cast("decimal(24,0)"),
                               F.col("_n_d").cast("decimal(12,0)"))).alias("days_mean"),
            variance("_n_d", "_s_d", "_q_d", 1).alias("days_var"),
            *[F.coalesce(f"cntdist_{d}", F.lit(0)).alias(f"cntdist_{d}") for d in dims],
        )
    )
