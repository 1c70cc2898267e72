"""Data-quality checks. Each returns one row, so checks can be unioned and run apart from the jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hindcast.operators.reliable import checkpointed


def _verdict(df: DataFrame, check: str, left: str, right: str, ok) -> DataFrame:
    return df.select(
        F.lit(check).alias("check_name"),
        F.col(left).cast("long").alias("found"),
        F.col(right).cast("long").alias("expected"),
        ok.alias("passed"),
    )


def unique_key(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """Rows against distinct keys. Keys are counted before the shuffle, in one pass."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        F.count(F.lit(1)).alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("b")
    )
    return _verdict(totals, check, "a", "b", F.col("a") == F.col("b"))


def _counts(left: DataFrame, right: DataFrame) -> DataFrame:
    sides = left.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        right.select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return sides.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")
    )


def same_row_count(left: DataFrame, right: DataFrame, check: str) -> DataFrame:
    return _verdict(_counts(left, right), check, "a", "b", F.col("a") == F.col("b"))


def not_more_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], check: str
) -> DataFrame:
    """The left side has at most as many distinct keys as the right side."""
    sides = _counts(left.select(*keys).distinct(), right.select(*keys).distinct())
    return _verdict(sides, check, "a", "b", F.col("a") <= F.col("b"))


def no_nulls(df: DataFrame, columns: Sequence[str], check: str) -> DataFrame:
    missing = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in columns])
    totals = df.agg(F.count(F.when(missing, 1)).alias("a")).withColumn("b", F.lit(0))
    return _verdict(totals, check, "a", "b", F.col("a") == 0)


def watched(
    df: DataFrame, nulls: Sequence[str] = (), **counts: Column
) -> tuple[DataFrame, dict[str, int]]:
    """Write ``df`` to the checkpoint folder and count on the way: (written table, figures).

    Figures are ``rows``, ``null_<column>`` for each of ``nulls`` and the rows where a condition in
    ``counts`` holds. They are collected by the job that writes, in its last stage, so a check costs
    no second evaluation and a task that is run again counts once. An empty table has zeros.
    """
    figures = {"rows": F.count(F.lit(1))}
    figures |= {f"null_{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in nulls}
    figures |= {name: F.count(F.when(holds, 1)) for name, holds in counts.items()}
    seen = Observation()
    written = checkpointed(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
    return written, {name: seen.get.get(name) or 0 for name in figures}


def from_figures(
    spark: SparkSession, check: str, found: int, expected: int, passed: bool
) -> DataFrame:
    """The row of a check whose figures :func:`watched` has collected."""
    one = spark.range(1).select(F.lit(found).alias("a"), F.lit(expected).alias("b"))
    return _verdict(one, check, "a", "b", F.lit(passed))


def same_columns(left: DataFrame, right: DataFrame) -> bool:
    """Whether two frames have the same columns in the same order."""
    return left.columns == right.columns


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
