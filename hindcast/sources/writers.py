"""Sinks. A rerun replaces exactly the partitions it produces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def store_path(root: str, name: str) -> str:
    """The one place where the location of a stored dataset is made up, for writers and readers."""
    return f"{root.rstrip('/')}/{name}"


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write Parquet, replacing only those partitions that occur in ``df``.

    Rows are spread over tasks by AQE's rebalancing first: it splits large partition values and
    packs small ones, so neither a hot value nor thousands of tiny files result.
    """
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
