"""Expressions across the columns of one row."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.functions.types import as_column


def row_sum(columns: Iterable[Column | str], skip_nulls: bool) -> Column:
    """Sum across columns. With ``skip_nulls`` a NULL counts as 0, else it makes the sum NULL."""
    cols = [as_column(c) for c in columns]
    if skip_nulls:
        cols = [F.coalesce(c, F.lit(0)) for c in cols]
    return reduce(add, cols)


def not_in_list(column: Column | str, values: Iterable[str]) -> Column:
    """True where the value is none of ``values``.

    As in SQL, a NULL value gives NULL, so a filter on this drops NULL ids as well.
    """
    return ~as_column(column).isin(*values)


def zero_when(condition: Column, amount: Column | str) -> Column:
    """0 where the condition is true; the amount where it is false or NULL."""
    amount = as_column(amount)
    return F.when(condition, F.lit(0)).otherwise(amount)


def strict_sum(column: Column | str) -> Column:
    """Aggregate sum that is NULL as soon as one value in the group is NULL."""
    column = as_column(column)
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def ratio_of_sums(numerator: Column | str, denominator: Column | str) -> Column:
    """Aggregate ``sum(a) / sum(b)`` as a double, NULL when the denominator sums to 0."""
    return F.try_divide(
        F.sum(as_column(numerator)).cast("double"), F.sum(as_column(denominator)).cast("double")
    )
