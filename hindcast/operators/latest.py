"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """For each key the row that is largest by ``order_by``, then by all its other columns.

    The full order makes the choice independent of how the rows are spread. It is an aggregation,
    not a ranking window: every task reduces its rows to one per key before the shuffle, so a key
    that holds a large part of the table is no hot spot.
    """
    return _one_per_key(df, keys, order_by, F.max)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """As :func:`latest_per_key` with the smallest row; NULLs come first."""
    return _one_per_key(df, keys, order_by, F.min)


def _one_per_key(df, keys, order_by, pick) -> DataFrame:
    ordered = list(order_by)
    ordered += sorted(c for c in df.columns if c not in {*keys, *order_by})
    # A largest struct is found by sorting. Led by a hash, the sort compares numbers and not keys.
    return (
        df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)
        .agg(pick(F.struct(*ordered)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )
