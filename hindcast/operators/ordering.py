"""Global order at scale: row numbers, ranks with ties, exact quantiles, top fractions.

A window without partition keys would pull the whole table into one task. Here the table is range
partitioned by Spark's own sort, and only the sizes of the sorted partitions, one row each, meet in
one place. The sorted table is checkpointed, because its partition borders come from a sample and
must be the same for both uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.reliable import checkpointed

# monotonically_increasing_id() keeps the row's place in its partition in the lower 33 bits.
_PLACE_BITS = 33


def _sorted_with_place(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    ordered = checkpointed(
        df.orderBy(*order_by).withColumn("_slot", F.monotonically_increasing_id())
    )
    return ordered.withColumns(
        {
            "_part": F.shiftright("_slot", _PLACE_BITS),
            "_place": F.col("_slot").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)),
        }
    )


def _offsets(ordered: DataFrame, amount: Column) -> DataFrame:
    """Total of all earlier partitions. One row per partition, so it is small by construction."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("_part").agg(amount.alias("_total"))
    return totals.select(
        "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )


def global_row_number(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_number"
) -> DataFrame:
    """Number the rows 1..n in a total order; end ``order_by`` with a unique key for that."""
    ordered = _sorted_with_place(df, order_by)
    offsets = F.broadcast(_offsets(ordered, F.count(F.lit(1))))
    return (
        ordered.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_place") + 1)
        .select(*df.columns, name)
    )


def first_fraction(
    df: DataFrame, order: Sequence[tuple[str, bool]], fraction: float, name: str,
    group: Sequence[str] = (),
) -> DataFrame:
    """Mark the first ``floor(n * fraction)`` rows, of all or of each ``group``.

    ``order`` names columns and whether they fall; falling columns have NULL last, others first.
    Together they must make the order total. Only these columns are sorted, to find the border row;
    the rows themselves are compared with it where they are.
    """
    group = list(group)
    keys = [F.col(c).desc_nulls_last() if falls else F.col(c).asc_nulls_first()
            for c, falls in order]
    narrow = df.select(*group, *[c for c, _ in order])
    numbered = global_row_number(narrow, [*group, *keys], "_number")
    sizes = numbered.groupBy(*group).agg(
        (F.min("_number") + F.floor(F.count(F.lit(1)) * F.lit(fraction)) - 1).alias("_last"))
    border = F.struct(*[F.col(c).alias(f"_{i}") for i, (c, _) in enumerate(order)])
    if group:
        pairs = sizes.select(*[F.col(c).alias(f"_g_{c}") for c in group], "_last")
        same = F.col("_number") == F.col("_last")
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        found = numbered.join(pairs, same).select(
            *[F.col(f"_g_{c}") for c in group], border.alias("_border"))
        same = F.lit(True)
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        marked = df.join(found, same, "left").drop(*[f"_g_{c}" for c in group])
    else:
        last = sizes.scalar()
        marked = df.withColumn(
            "_border", numbered.filter(F.col("_number") == last).select(border).scalar())
    within = F.lit(True)
    for i, (c, falls) in reversed(list(enumerate(order))):
        own, other = F.col(c), F.col(f"_border._{i}")
        before = (own > other) if falls else (own < other)
        null_side = other if falls else own
        before = F.coalesce(before, null_side.isNull() & ~own.eqNullSafe(other))
        within = before | (own.eqNullSafe(other) & within)
    return marked.withColumn(name, F.col("_border").isNotNull() & within).drop("_border")


def top_fraction(
    df: DataFrame, score: str, fraction: float, ties: Sequence[str], name: str = "in_top",
    group: Sequence[str] = (),
) -> DataFrame:
    """Mark the first ``floor(n * fraction)`` rows by falling score; ``ties`` make the order total."""
    return first_fraction(df, [(score, True), *[(c, False) for c in ties]], fraction, name, group)


def cells_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``column_name, value`` (double) of the named columns, without NULLs."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(cells)).filter("value is not null")


def value_ranks(cells: DataFrame, weight: str | None = None) -> DataFrame:
    """Distinct values per ``column_name`` with row count ``n``, ``below`` and average ``rank``.

    ``cells`` is a long table ``column_name, value``, of which ``weight`` may count the rows; the
    name may be a struct. All groups are ranked in one pass: values are counted before they are
    shuffled, so 97 % zeros are one row, and only distinct values are sorted.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = cells.groupBy("column_name", "value").agg(rows.alias("n"))
    ordered = _sorted_with_place(counted, ["column_name", "value"])
    earlier = (
        Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = F.broadcast(_offsets(ordered, F.sum("n")))
    summed = ordered.join(offsets, "_part").withColumn(
        "_before", F.col("_offset") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    )
    starts = summed.groupBy("column_name").agg(
        F.min("_before").alias("_start"), F.sum("n").alias("total")
    )
    below = F.col("_before") - F.col("_start")
    return summed.join(starts, "column_name").select(
        "column_name", "value", "n", "total", below.alias("below"),
        (below + (F.col("n") + 1) / 2).alias("rank"),
    )


def exact_quantiles(cells: DataFrame, q: float) -> DataFrame:
    """``column_name, quantile``: linear interpolation between the two neighbouring ranks."""
    return quantile_table(cells, [q]).select("column_name", "quantile")


def quantile_table(cells: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``column_name, q, quantile`` for several shares ``q`` from one ranking pass."""
    asked = F.explode(F.array(*[F.lit(float(q)) for q in shares]))
    ranks = value_ranks(cells).withColumn("q", asked)
    at = (F.col("total") - 1) * F.col("q")
    low, high = F.floor(at), F.ceil(at)

    def holds(place: Column) -> Column:
        return (F.col("below") <= place) & (place < F.col("below") + F.col("n"))

    near = (
        ranks.filter(holds(low) | holds(high))
        .groupBy("column_name", "q")
        .agg(F.min("value").alias("a"), F.max("value").alias("b"), F.max(at - low).alias("w"))
    )
    return near.select(
        "column_name", "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("quantile")
    )


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row ``quantile``."""
    return exact_quantiles(cells_of(df, [column]), q).select("quantile")


def approximate_quantile(
    df: DataFrame, column: str, q: float, accuracy: int = 10000
) -> DataFrame:
    """One row ``quantile``: a value of the column whose rank is off by at most n / accuracy."""
    return df.agg(F.percentile_approx(column, F.lit(q), F.lit(accuracy)).alias("quantile"))


def rank_correlations(
    df: DataFrame, pairs: Sequence[tuple[str, str]], group: Sequence[str] = ()
) -> DataFrame:
    """Spearman's rho of each pair of columns, with average ranks for ties.

    A row counts for a pair when both its values are known, whatever the other columns hold, and
    ranks are those among the rows of the pair. Equal pairs of values are counted first, in one
    checkpointed pass; both sides of all pairs are ranked together and looked up by equi joins.
    Ranks are centred before they are multiplied, so the sums do not cancel. ``group`` columns give
    one result per group, none for a NULL group. Result: ``group, left_column, right_column, rho``.
    """
    group = list(group)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"), F.col(a).cast("double").alias("left_value"),
                F.col(b).cast("double").alias("right_value"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    counted = checkpointed(
        df.select(*group, F.inline(cells)).dropna(subset=["left_value", "right_value"])
        .groupBy(*group, "pair", "left_value", "right_value")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    sides = F.array(*[
        F.struct(F.struct(*group, "pair", F.lit(side).alias("side")).alias("column_name"),
                 F.col(f"{side}_value").alias("value"))
        for side in ("left", "right")
    ])
    ranks = checkpointed(value_ranks(counted.select(F.inline(sides), "weight"), "weight").select(
        "column_name.*", "value", (F.col("rank") - (F.col("total") + 1) / 2).alias("centred")
    ))
    for side in ("left", "right"):
        lookup = ranks.filter(F.col("side") == side).select(
            *group, "pair", F.col("value").alias(f"{side}_value"),
            F.col("centred").alias(f"{side}_rank"),
        )
        counted = counted.join(lookup, [*group, "pair", f"{side}_value"])
    names = F.array(*[
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column")) for a, b in pairs
    ])
    weight, x, y = F.col("weight"), F.col("left_rank"), F.col("right_rank")
    return counted.withColumn("_names", F.get(names, F.col("pair"))).groupBy(
        *group, F.col("_names.left_column"), F.col("_names.right_column")
    ).agg(
        F.try_divide(
            F.sum(weight * x * y), F.sqrt(F.sum(weight * x * x)) * F.sqrt(F.sum(weight * y * y))
        ).alias("rho")
    )
