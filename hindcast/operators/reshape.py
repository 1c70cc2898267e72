"""Long to wide and back. Pivots name their values, so none needs a job to find them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_sum(
    df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], amount: str,
    suffix: str = "", fill: bool = True,
) -> DataFrame:
    """One row per key and one summed column per listed value; 0 (or NULL) where there is none.

    Keys whose rows all have other values stay, as rows of zeros.
    """
    sums = [
        F.sum(F.when(F.col(column) == v, F.col(amount))).alias(f"{v}{suffix}") for v in values
    ]
    wide = df.groupBy(*keys).agg(*sums)
    return wide.fillna(0, subset=[f"{v}{suffix}" for v in values]) if fill else wide


def suffix_columns(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    """Append a suffix to the named columns, in one projection."""
    return df.select(
        *[F.col(c).alias(c + suffix if c in set(columns) else c) for c in df.columns]
    )


def unpivot_scores(
    df: DataFrame, keep: Sequence[str], scores: Sequence[str], name: str = "score_name",
    value: str = "score",
) -> DataFrame:
    """One row per input row and score column."""
    return df.unpivot(list(keep), list(scores), name, value)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
