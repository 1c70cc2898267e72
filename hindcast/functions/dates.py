"""Date arithmetic: month steps, horizons, overlaps and pro-rating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.functions.types import as_column


def parse_date(c: Column | str, fmt: str | None = None) -> Column:
    """Date of a string, date or timestamp; NULL when a string cannot be read."""
    c = as_column(c)
    return F.try_to_date(c, fmt) if fmt else F.try_to_date(c.cast("string"))


def months_back(date: Column | str, months: int | Column) -> Column:
    """Same day ``months`` earlier, clamped to the end of a shorter month."""
    if isinstance(months, int):
        return F.add_months(as_column(date), -months)
    return F.add_months(as_column(date), -months)


def horizon_end(start: Column | str, months: int) -> Column:
    """Last day of a horizon of ``months`` that begins on ``start``."""
    return F.date_sub(F.add_months(as_column(start), months), 1)


def days_since(event_date: Column | str, earlier: Column | str) -> Column:
    return F.date_diff(as_column(event_date), as_column(earlier).cast("date"))


def date_parts(column: str) -> list[Column]:
    """Day of week (1 = Sunday), day of month and month, named after the column."""
    c = F.col(column)
    return [
        F.dayofweek(c).alias(f"{column}_dow"),
        F.dayofmonth(c).alias(f"{column}_dom"),
        F.month(c).alias(f"{column}_month"),
    ]


def overlaps(eff: Column | str, exp: Column | str, on: Column | str, off: Column | str) -> Column:
    """True when two date ranges, both ends included, share a day."""
    return (as_column(eff) <= as_column(off)) & (as_column(exp) >= as_column(on))


def overlap_days(
    eff: Column | str, exp: Column | str, on: Column | str, off: Column | str
) -> Column:
    eff, exp, on, off = (as_column(c) for c in (eff, exp, on, off))
    return F.date_diff(F.least(exp, off), F.greatest(eff, on))


def prorate(
    amount: Column | str,
    days: Column | str,
    eff: Column | str,
    exp: Column | str,
    on: Column | str,
    off: Column | str,
) -> Column:
    """Part of an amount over ``[eff, exp]`` that falls in ``[on, off]``, as decimal with 6 places.

    A range wholly inside keeps its amount as it is, also when it lasts 0 days. Use together with a
    filter on :func:`overlaps`.
    """
    amount, days, eff, exp, on, off = (as_column(c) for c in (amount, days, eff, exp, on, off))
    inside = (eff >= on) & (exp <= off)
    share = F.try_divide(
        amount.cast("decimal(18,2)") * overlap_days(eff, exp, on, off).cast("decimal(8,0)"),
        days.cast("decimal(8,0)"),
    )
    return F.when(inside, amount.cast("decimal(24,6)")).otherwise(
        F.round(share, 6).cast("decimal(24,6)")
    )
