"""Profiles that are saved per partition and merged without reading the table again.

A table that grows by partitions (days, months) is profiled a partition at a time: one row per
partition and column with exact counts, extremes and sums and two mergeable sketches, a few kB. The
profile of any set of partitions is a merge of such rows; a partition that is written again has its
rows replaced, the others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.ordering import cells_of, quantile_table

# Sketch sizes: 2^12 registers count distinct values within 1.6 % (one standard deviation), 400
# entries hold ranks within 0.7 %.
DISTINCT_BITS, QUANTILE_ENTRIES = 12, 400
DISTINCT_ERROR, RANK_ERROR = 0.016, 0.007
QUARTILES = (0.25, 0.5, 0.75)


def column_sketches(
    df: DataFrame, columns: Sequence[str], partition: Sequence[str] = ()
) -> DataFrame:
    """``partition..., column_name, rows, filled, smallest, largest, total, distinct, ranks``.

    One pass; tasks reduce their rows to sketches before the shuffle, so a partition with a third
    of all rows sends a row per task. Distinct values are those of the text form. ``smallest``,
    ``largest``, ``total`` and ``ranks`` are NULL for columns that are no numbers or have no value,
    ``distinct`` is NULL without a value. NULL and NaN numbers have no rank. An empty table gives no
    rows with a ``partition``, else rows of zeros.
    """
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    stats = []
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        value = F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
        value = F.when(~F.isnan(value), value)
        stats.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.lit(1)).alias("rows"),
                F.count(c).alias("filled"),
                F.min(value).alias("smallest"),
                F.max(value).alias("largest"),
                F.sum(value).alias("total"),
                F.when(
                    F.count(c) > 0, F.hll_sketch_agg(text, F.lit(DISTINCT_BITS))
                ).alias("distinct"),
                F.when(
                    F.count(value) > 0, F.kll_sketch_agg_double(value, F.lit(QUANTILE_ENTRIES))
                ).alias("ranks"),
            ).alias(f"_s{i}")
        )
    found = df.groupBy(*partition).agg(*stats)
    rows = F.inline(F.array(*[f"_s{i}" for i in range(len(columns))]))
    return found.select(*partition, rows)


def merged_profile(
    sketches: DataFrame, shares: Sequence[float] = QUARTILES, group: Sequence[str] = ()
) -> DataFrame:
    """Profile per column (and ``group``) from rows of :func:`column_sketches`.

    ``rows, null_ratio, smallest, largest, mean`` are exact; ``distinct_values``, where NULL counts
    as a value, and the array ``quantiles``, one per share, are within the sketches' error.
    """
    keys = [*group, "column_name"]
    merged = sketches.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"),
        F.min("smallest").alias("smallest"), F.max("largest").alias("largest"),
        F.sum("total").alias("total"),
        F.when(F.count("distinct") > 0, F.hll_union_agg("distinct")).alias("distinct"),
        F.when(F.count("ranks") > 0, F.kll_merge_agg_double("ranks")).alias("ranks"),
    )
    known = F.kll_sketch_get_n_double("ranks")
    distinct = F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0))
    at = F.array(*[F.lit(float(q)) for q in shares])
    return merged.select(
        *keys, "rows",
        F.round(F.try_divide(F.col("rows") - F.col("filled"), F.col("rows")), 4).alias("null_ratio"),
        (distinct + (F.col("filled") < F.col("rows")).cast("long")).alias("distinct_values"),
        "smallest", "largest", F.try_divide(F.col("total"), known).alias("mean"),
        F.kll_sketch_get_quantile_double("ranks", at).alias("quantiles"),
    )


def exact_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, count, mean, stddev, min, q25, q50, q75, max``, all exact, NULLs left out.

    Moments come from one aggregation, quartiles of all columns (interpolated) from one ranking
    pass. A column without values has no row; the deviation of one value is NULL.
    """
    cells = cells_of(df, columns)
    moments = cells.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    )

    def at(q: float) -> Column:
        return F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(f"q{round(q * 100)}")

    quartiles = quantile_table(cells, QUARTILES).groupBy("column_name").agg(*map(at, QUARTILES))
    return moments.join(quartiles, "column_name").select(
        "column_name", "count", "mean", "stddev", "min", "q25", "q50", "q75", "max"
    )
