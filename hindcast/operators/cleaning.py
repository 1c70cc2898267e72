"""Selecting, renaming, filtering and profiling columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.functions.rows import not_in_list

# Ids that stand for "no real driver / vehicle" in the source systems.
DRIVER_NOISE_IDS = (
    "COMPANY", "UNLICENSED", "COMPAGNIE", "FLEET", "$$UNLICENSED", "$$COMPANY", "1234567", "",
    "UNKNOWN", "Unknown_DLN",
)
VEHICLE_NOISE_IDS = ("", "1234567", "12345678", "SEARCH", "123456", "NF")
VEHICLE_HISTORY_NOISE_IDS = (
    "", "0", "NOT APPLICABLE", "TRAILER", "XXXXXXXXXXXXXXXXX", "XXX", "XXXX", "X", "00000000",
    "123456", "000000", "00000", "0000",
)


def project(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    rename: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
    constants: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Keep a column list, drop names that may be absent, rename, and add constant columns."""
    names = [c for c in (keep or df.columns) if c not in set(drop)]
    rename = rename or {}
    out = [F.col(c).alias(rename.get(c, c)) for c in names]
    out += [c.alias(name) for name, c in (constants or {}).items()]
    return df.select(*out)


def drop_noise_ids(df: DataFrame, noise: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop rows whose id is NULL or one of the noise values of its column."""
    for column, values in noise.items():
        df = df.filter(not_in_list(column, values))
    return df


def between_dates(
    df: DataFrame, column: str, start: str, end: str | None = None, end_inclusive: bool = True
) -> DataFrame:
    """Rows dated from ``start`` up to ``end``; without an end the range is open."""
    c = F.col(column)
    df = df.filter(c >= F.to_date(F.lit(start)))
    if end is None:
        return df
    stop = F.to_date(F.lit(end))
    return df.filter(c <= stop if end_inclusive else c < stop)


def columns_of_type(df: DataFrame, *types: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def columns_matching(df: DataFrame, pattern: str, not_ending: str | None = None) -> list[str]:
    return [
        c
        for c in df.columns
        if re.search(pattern, c) and not (not_ending and c.endswith(not_ending))
    ]


def narrow_numbers(df: DataFrame) -> DataFrame:
    """Turn decimal and double columns into 32-bit floats, as a last step before model training."""
    wide = columns_of_type(df, T.DecimalType, T.DoubleType)
    return df.withColumns({c: F.col(c).cast("float") for c in wide})


def timestamps_to_days(df: DataFrame, event_date: str) -> DataFrame:
    """Replace each timestamp column, with or without time zone, by its days before the event."""
    stamps = columns_of_type(df, T.TimestampType, T.TimestampNTZType)
    rest = [F.col(c) for c in df.columns if c not in stamps]
    return df.select(
        *rest,
        *[
            F.date_diff(F.col(event_date), F.col(c).cast("date")).alias(f"{c}_dayssince")
            for c in stamps
        ],
    )


def days_before_reference(
    df: DataFrame, columns: Sequence[str], reference: str, suffix: str = "_diff"
) -> DataFrame:
    """Replace the date columns that exist by their days before one fixed date."""
    present = [c for c in columns if c in df.columns]
    ref = F.to_date(F.lit(reference))
    return df.withColumns(
        {c + suffix: F.date_diff(ref, F.col(c).cast("date")) for c in present}
    ).drop(*present)


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """0 for NULL in the named columns, or in all numeric ones."""
    return df.fillna(0, subset=list(columns) if columns else None)


def exclude_features(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Drop every column that starts with a prefix; an error when there is none to drop."""
    out = [c for c in df.columns if c.startswith(tuple(prefixes))]
    if not out:
        raise ValueError(f"no column starts with any of {list(prefixes)}")
    return df.drop(*out)


def column_profile(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Per column: share of NULLs and number of distinct values, where NULL counts as a value.

    The exact form turns the table into (column, value) pairs that are counted before they are
    shuffled, so a hot value travels once per task. The approximate form is one pass with sketches.
    """
    columns = list(columns or df.columns)
    if approximate:
        stats = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.lit(1)).alias("rows"),
                F.count(c).alias("filled"),
                F.approx_count_distinct(c).alias("values"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
        flat = df.agg(*stats).select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))
        distinct = F.col("values") + (F.col("filled") < F.col("rows")).cast("long")
        return flat.select(
            "column_name", _null_ratio("rows", "filled"), distinct.alias("distinct_values")
        )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    counted = (
        df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("column_name").agg(
        F.round(
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 4
        ).alias("null_ratio"),
        F.count(F.lit(1)).alias("distinct_values"),
    )


def _null_ratio(rows: str, filled: str) -> Column:
    return F.round(F.try_divide(F.col(rows) - F.col(filled), F.col(rows)), 4).alias("null_ratio")


def low_information_columns(df: DataFrame, max_null_ratio: float = 0.999) -> DataFrame:
    """One row per column: is it almost always NULL, or the same value in every row?

    "Same value" needs no distinct count: smallest and largest agree and nothing is NULL, or all
    is NULL. That makes it a single pass with one row of result.
    """
    stats = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("rows"),
            F.count(c).alias("filled"),
            (F.min(c) == F.max(c)).alias("constant"),
        ).alias(f"s{i}")
        for i, c in enumerate(df.columns)
    ]
    flat = df.agg(*stats).select(F.inline(F.array(*[f"s{i}" for i in range(len(df.columns))])))
    rows, filled = F.col("rows"), F.col("filled")
    sparse = (rows - filled) >= rows * F.lit(max_null_ratio)
    single = (filled == 0) | ((filled == rows) & F.coalesce("constant", F.lit(False)))
    return flat.select("column_name", (sparse | single).alias("low_information"))


def prune_low_information(df: DataFrame, max_null_ratio: float = 0.999) -> DataFrame:
    """Drop the columns of :func:`low_information_columns`; runs one aggregation to learn them."""
    found = low_information_columns(df, max_null_ratio).filter("low_information").collect()
    return df.drop(*[row["column_name"] for row in found])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and (approximate) quartiles of numeric columns."""
    return df.select(*columns).summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")
