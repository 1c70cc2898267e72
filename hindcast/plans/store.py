"""Feature store: claim and exposure figures per id and month end, and their lookup at a date.

The store is kept as rows per id and snapshot. The nested form is a view of it: the map of an id has
at most one entry per month end, and each inner map one per feature, so its size is set by the
calendar and not by the number of claims.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast import COVERAGES, TRIPLET
from hindcast.functions.maps import (
    latest_snapshot,
    map_to_vector,
    merge_maps,
    vector_to_columns,
)
from hindcast.operators.retro import (
    DEFAULT_RETRO_MONTHS,
    EXPOSURE_WINDOWS,
    MonthEnds,
    month_end_until,
    retro_exposures,
    retro_losses,
)
from hindcast.operators.timeline import read_timeline
from hindcast.sources import overwrite_partitions, read_parquet, store_path

CLAIM_STORE = "feature_store_claim"
EXPOSURE_STORE = "feature_store_exposure"
KINDS = {"bin": "bins", "acum": "acum"}


def claim_store(
    claims: DataFrame, id_column: str, calendar: MonthEnds,
    coverages: Sequence[str] = COVERAGES, retro_months: int = DEFAULT_RETRO_MONTHS,
) -> DataFrame:
    return retro_losses(claims, id_column, calendar, coverages, retro_months)


def exposure_store(
    sessions: DataFrame, id_column: str, calendar: MonthEnds,
    windows: Sequence[tuple[int, int]] = EXPOSURE_WINDOWS,
) -> DataFrame:
    others = [k for k in TRIPLET if k != id_column]
    return retro_exposures(sessions, id_column, others, calendar, windows)


def save_claim_store(stored: DataFrame, id_column: str, root: str) -> None:
    """Write the store of one id kind; a rerun replaces the coverages it holds and no others."""
    rows = stored.withColumnRenamed(id_column, "id").withColumn("kk", F.lit(id_column))
    overwrite_partitions(rows, store_path(root, CLAIM_STORE), ["kk", "cvg"])


def load_claim_store(spark: SparkSession, id_column: str, root: str) -> DataFrame:
    """The store of one id kind; only its own partitions are read."""
    rows = read_parquet(spark, store_path(root, CLAIM_STORE)).filter(F.col("kk") == id_column)
    return rows.select(F.col("id").alias(id_column), "cvg", "dt", "bins", "acum")


def save_claim_table(
    stored: DataFrame, id_column: str, table: str, folder: str, buckets: int
) -> None:
    """Write the store of one id kind as a catalog table over ``folder``, bucketed by id.

    A table of that name is replaced. There is one file per bucket, sorted by id and date. An id has at
    most one row per coverage and month end, so buckets differ little in size.
    """
    (
        stored.repartition(buckets, id_column)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", folder)
        .bucketBy(buckets, id_column)
        .sortBy(id_column, "dt", "cvg")
        .saveAsTable(table)
    )


def save_exposure_store(stored: DataFrame, id_column: str, root: str) -> None:
    """Write the exposure store of one id kind; a rerun replaces that kind and no other."""
    rows = stored.withColumnRenamed(id_column, "id").withColumn("kk", F.lit(id_column))
    others = [k for k in TRIPLET if k != id_column]
    rows = rows.withColumnsRenamed({f"cntdist_{k}": f"cntdist_{i}" for i, k in enumerate(others)})
    overwrite_partitions(rows, store_path(root, EXPOSURE_STORE), ["kk"])


def load_exposure_store(spark: SparkSession, id_column: str, root: str) -> DataFrame:
    """The exposure store of one id kind; only its own partition is read."""
    rows = read_parquet(spark, store_path(root, EXPOSURE_STORE)).filter(F.col("kk") == id_column)
    others = [k for k in TRIPLET if k != id_column]
    named = {"id": id_column, **{f"cntdist_{i}": f"cntdist_{k}" for i, k in enumerate(others)}}
    return rows.drop("kk").withColumnsRenamed(named)


def loss_feature(id_column: str, kind: str, coverage: str, months: int) -> str:
    return f"{id_column}_loss_sum_retro_{kind}_{coverage}_{months}"


def _dated_maps(rows: DataFrame, id_column: str, entries: Column) -> DataFrame:
    """``id, properties``: the entries of one snapshot, keyed by its date."""
    dated = F.struct(
        F.date_format("dt", "yyyy-MM-dd").alias("key"), F.map_from_entries("entries").alias("value")
    )
    return (
        rows.select(id_column, "dt", entries.alias("entries"))
        .groupBy(id_column)
        .agg(F.map_from_entries(F.collect_list(dated)).alias("properties"))
    )


def nested_claim_store(stored: DataFrame, id_column: str, coverage: str) -> DataFrame:
    """One row per id: ``{date: {feature: value}}`` of one coverage, positive values only."""

    def entries(kind: str) -> Column:
        named = F.transform(
            KINDS[kind],
            lambda x, m: F.struct(
                F.concat(
                    F.lit(f"{id_column}_loss_sum_retro_{kind}_{coverage}_"), m.cast("string")
                ).alias("key"),
                x.cast("bigint").alias("value"),
            ),
        )
        return F.filter(named, lambda e: e["value"] > 0)

    rows = stored.filter(F.col("cvg") == coverage)
    return _dated_maps(rows, id_column, F.concat(entries("bin"), entries("acum")))


def nested_exposure_store(stored: DataFrame, id_column: str) -> DataFrame:
    """One row per id: ``{date: {feature: value}}`` over all windows."""
    others = [k for k in TRIPLET if k != id_column]
    names = {
        "prem_sum": "prem_sum_retro_accum",
        "prem_var": "prem_var_retro_accum",
        "prem_mean": "prem_mean_retro_accum",
        **{f"cntdist_{d}": f"retro_cntdist_{d}" for d in (*others, "term_eff", "ver_eff")},
        "days_mean": "retro_mean_ver_days",
        "days_var": "retro_var_ver_days",
    }
    window = F.concat_ws("_", F.col("near_months"), F.col("far_months"))
    figures = F.array(
        *[
            F.struct(
                F.concat_ws("_", F.lit(f"{id_column}_{name}"), window).alias("key"),
                F.col(c).cast("bigint").alias("value"),
            )
            for c, name in names.items()
        ]
    )
    # at most one row per window, so the list of an (id, dt) has a fixed length
    rows = (
        stored.select(id_column, "dt", figures.alias("figures"))
        .groupBy(id_column, "dt")
        .agg(F.flatten(F.collect_list("figures")).alias("all_figures"))
    )
    return _dated_maps(rows, id_column, F.col("all_figures"))


def loss_feature_names(
    ids: Sequence[str], coverages: Sequence[str], retro_months: int
) -> list[str]:
    return [
        loss_feature(kk, kind, cvg, m)
        for kk in ids
        for cvg in coverages
        for m in range(retro_months + 1)
        for kind in KINDS
    ]


def _lookup(
    events: DataFrame, stored: DataFrame, id_column: str, coverages: Sequence[str]
) -> DataFrame:
    """Per distinct (id, date) of the events the newest entry of each coverage, date included."""
    wide = stored.groupBy(id_column, "dt").agg(
        *[
            F.max(F.when(F.col("cvg") == c, F.struct("bins", "acum"))).alias(f"_{id_column}_{c}")
            for c in coverages
        ]
    )
    asked = events.select(id_column, "ver_eff").dropna().distinct()
    values = [f"_{id_column}_{c}" for c in coverages]
    return read_timeline(asked, wide, [id_column], "ver_eff", "dt", values)


def _lookup_in_buckets(
    events: DataFrame, stored: DataFrame, id_column: str, coverages: Sequence[str], buckets: int
) -> DataFrame:
    """:func:`_lookup` on a table bucketed by id, none of whose rows is shuffled before it is found.

    An entry holds from its date up to the next of its id and coverage. Each entry picks the dates asked
    for its id that it holds at; both sides of that join are bounded by the calendar per id, and only
    entries that some date needs leave it.
    """
    asked = events.select(id_column, "ver_eff").dropna().distinct().repartition(buckets, id_column)
    dates = asked.groupBy(id_column).agg(F.collect_list("ver_eff").alias("_asked"))
    following = Window.partitionBy(id_column, "cvg").orderBy("dt")
    entries = stored.filter(F.col(id_column).isNotNull() & F.col("cvg").isin(*coverages))
    entries = entries.withColumn("_until", F.lead("dt").over(following))

    def holds(day: Column) -> Column:
        until = F.col("_until")
        return (day >= F.col("dt")) & (until.isNull() | (day < until))

    picked = entries.join(dates, id_column).select(
        id_column, F.explode(F.filter("_asked", holds)).alias("ver_eff"), "cvg",
        F.struct("bins", "acum").alias("entry"))
    found = picked.groupBy(id_column, "ver_eff").agg(
        F.map_from_entries(F.collect_list(F.struct("cvg", "entry"))).alias("_entries"))
    return found.select(id_column, "ver_eff", *[
        F.try_element_at("_entries", F.lit(c)).alias(f"_{id_column}_{c}") for c in coverages])


def point_in_time_features(
    events: DataFrame,
    stores: Mapping[str, DataFrame],
    coverages: Sequence[str] = COVERAGES,
    retro_months: int = DEFAULT_RETRO_MONTHS,
    buckets: int | None = None,
) -> DataFrame:
    """Events with one column per id, coverage, month and kind; 0 where the store has nothing.

    Each coverage is looked up on its own: the newest snapshot that has an entry for it counts, even
    if a newer one exists for another coverage. A store has one row per id, coverage and date; of
    repeated ones any counts. With stores read from tables of :func:`save_claim_table`, pass their number of ``buckets``: the ids and
    dates asked for are then dealt like the tables, whose rows are looked up where they lie.
    """
    joined = events
    for kk, stored in stores.items():
        if buckets:
            found = _lookup_in_buckets(events, stored, kk, coverages, buckets)
        else:
            found = _lookup(events, stored, kk, coverages)
        joined = joined.join(found, [kk, "ver_eff"], "left")
    values = [
        f"cast(coalesce(get(_{kk}_{c}.{field}, {m}), 0) as bigint) as "
        f"`{loss_feature(kk, kind, c, m)}`"
        for kk in stores
        for c in coverages
        for m in range(retro_months + 1)
        for kind, field in KINDS.items()
    ]
    return joined.selectExpr(*[f"`{c}`" for c in events.columns], *values)


def nested_features(
    events: DataFrame, nested: Mapping[str, DataFrame], id_column: str, names: Sequence[str],
    total: str,
) -> DataFrame:
    """Events with the named features of the newest snapshots in nested stores, one per coverage.

    ``total`` is over all features of the merged maps. Snapshots lie at month ends, so days between
    two of them see the same ones: maps are looked up once per id and month, and only the figures go
    back to the events, which are read twice. Events without id, date or entry get 0.
    """
    rows = events.withColumn("_seen", month_end_until("ver_eff"))
    asked = rows.select(id_column, "_seen").dropna().distinct()
    for c, maps_of_ids in nested.items():
        asked = asked.join(maps_of_ids, id_column, "left").withColumn(
            f"_{c}", latest_snapshot("properties", "_seen")
        ).drop("properties")
    picked = [f"_{c}" for c in nested]
    merged = asked.withColumn("_all", merge_maps(picked)).drop(*picked)
    found = merged.withColumn("_vector", map_to_vector("_all", names)).withColumn(
        total, F.aggregate(F.map_values("_all"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    ).drop("_all")
    figures = features_from_vector(found, "_vector", names)
    joined = rows.join(figures, [id_column, "_seen"], "left")
    return joined.select(
        *events.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in (total, *names)])


def features_from_vector(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Replace an array column by one named column per element."""
    return df.select(
        *[c for c in df.columns if c != vector], *vector_to_columns(vector, names)
    )
