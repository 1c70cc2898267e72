"""Exposure preparation: from raw policy versions to one premium-bearing session per vehicle start."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hindcast import SESSION_KEYS
from hindcast.functions.dates import days_since, parse_date
from hindcast.functions.rows import zero_when
from hindcast.functions.types import MONEY, as_money
from hindcast.operators.cleaning import (
    DRIVER_NOISE_IDS,
    VEHICLE_NOISE_IDS,
    between_dates,
    drop_noise_ids,
)
from hindcast.operators.latest import latest_per_key

TERM_KEYS = ("policy_num", "vin", "term_eff")
VEHICLE_KEYS = ("policy_num", "vin")
DRIVER_TERM_KEYS = ("vin", "dln", "policy_num", "term_eff", "term_days")


def union_exposures(sources: Sequence[DataFrame]) -> DataFrame:
    """Exposures of several systems with common types, matched by column name.

    A date or number that cannot be read becomes NULL; the filters that follow decide on the row.
    """
    both = reduce(lambda a, b: a.unionByName(b), sources)
    read = [c for c in ("ver_eff", "ver_exp", "term_eff") if dict(both.dtypes)[c] != "date"]
    return both.withColumns(
        {
            **{c: parse_date(c) for c in read},
            "term_days": F.col("term_days").try_cast("int"),
            "expos_num": F.col("expos_num").try_cast("int"),
            "ft_prem": F.col("ft_prem").try_cast(MONEY),
        }
    )


def clean_exposures(
    sources: Sequence[DataFrame],
    start: str,
    end: str,
    driver_noise: Sequence[str] = DRIVER_NOISE_IDS,
    vehicle_noise: Sequence[str] = VEHICLE_NOISE_IDS,
) -> DataFrame:
    """Distinct exposures of terms that begin in the period, of real drivers and vehicles.

    Dealt by vehicle of a policy, so that the checks and sums per term and session that follow need
    no further shuffle.
    """
    df = between_dates(union_exposures(sources), "term_eff", start, end)
    df = drop_noise_ids(df, {"vin": vehicle_noise, "dln": driver_noise})
    df = df.filter("ft_prem >= 0").withColumn("ver_days", days_since("ver_exp", "ver_eff"))
    return df.repartition(*VEHICLE_KEYS).distinct()


def consistent_exposures(exposures: DataFrame) -> DataFrame:
    """Exposures of terms with one length and of driver terms with one exposure number.

    "One value" is smallest = largest, so no distinct count is needed. Both checks are windows over
    one order of the rows, by term and in it by driver: the driver terms lie inside the terms, so they
    need no sort of their own, and the input is read once. Rows that :func:`clean_exposures` has
    dealt by vehicle are not shuffled; others are, by ``TERM_KEYS``. A window holds one term of one
    vehicle. Rows with a NULL key never pass.
    """
    known = exposures.dropna(subset=list(DRIVER_TERM_KEYS))
    inside = [k for k in DRIVER_TERM_KEYS if k not in TERM_KEYS]
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    term = Window.partitionBy(*TERM_KEYS).orderBy(*inside).rowsBetween(*whole)
    driver_term = Window.partitionBy(*TERM_KEYS, *inside)

    def one_value(column: str, group: WindowSpec) -> Column:
        return F.min(column).over(group) == F.max(column).over(group)

    checked = known.withColumn("_terms", one_value("term_days", term)).withColumn(
        "_drivers", one_value("expos_num", driver_term))
    return checked.filter("_terms and _drivers").drop("_terms", "_drivers")


def session_premium(annual: str, term_days: str, ver_days: str) -> Column:
    """Annual premium scaled to the days of the session, rounded to cents; NULL for a 0-day term."""
    scaled = F.try_divide(
        F.col(annual).cast("decimal(20,2)") * F.col(ver_days).cast("decimal(8,0)"),
        F.col(term_days).cast("decimal(8,0)"),
    )
    return as_money(F.round(scaled, 2))


def session_premiums(exposures: DataFrame, loaded: str = "loaded_timest") -> DataFrame:
    """Premium per session, driver type and load time, of consistent terms only."""
    summed = (
        consistent_exposures(exposures)
        .groupBy(*SESSION_KEYS, "driver_type", loaded)
        .agg(F.sum("ft_prem").alias("_annual"))
    )
    return summed.select(
        *SESSION_KEYS, "driver_type", loaded,
        session_premium("_annual", "term_days", "ver_days").alias("session_prem"),
    )


def latest_sessions(premiums: DataFrame, loaded: str = "loaded_timest") -> DataFrame:
    """The most recently loaded session per vehicle, policy and start."""
    return latest_per_key(premiums, ["vin", "policy_num", "ver_eff"], [loaded]).drop(loaded)


def without_secondary_premium(sessions: DataFrame) -> DataFrame:
    """Sessions of secondary drivers carry no premium."""
    secondary = F.col("driver_type") == "secondary"
    return sessions.select(
        *SESSION_KEYS, as_money(zero_when(secondary, "session_prem")).alias("session_prem")
    )


def exposure_sessions(
    sources: Sequence[DataFrame], start: str, end: str, loaded: str = "loaded_timest"
) -> DataFrame:
    """Sessions of a study period, one per vehicle, policy and start date."""
    exposures = clean_exposures(sources, start, end)
    return without_secondary_premium(latest_sessions(session_premiums(exposures, loaded), loaded))


def bundle_terms(sessions: DataFrame) -> DataFrame:
    """One row per driver term: first start, last end, days and premium."""
    return sessions.groupBy(*DRIVER_TERM_KEYS).agg(
        F.min("ver_eff").alias("ver_eff"),
        F.max("ver_exp").alias("ver_exp"),
        F.sum("ver_days").alias("ver_days"),
        F.sum("session_prem").alias("session_prem"),
    )


def premium_by_driver_type(
    premiums: DataFrame, loaded: str = "loaded_timest"
) -> DataFrame:
    """Sessions with a primary driver, next to the iso and secondary driver of the same session.

    The premium is that of the primary plus that of the iso driver. Of several drivers of a type the
    most recently loaded one counts.
    """
    keys = [k for k in SESSION_KEYS if k != "dln"]
    types = ("primary", "iso", "secondary")
    picked = premiums.groupBy(*keys).agg(
        *[
            F.max(
                F.when(F.col("driver_type") == t, F.struct(loaded, "dln", "session_prem"))
            ).alias(t)
            for t in types
        ]
    )
    total = F.col("primary.session_prem") + F.coalesce("iso.session_prem", F.lit(0))
    return picked.filter("primary is not null").select(
        *keys, *[F.col(f"{t}.dln").alias(f"dln_{t}") for t in types],
        as_money(total).alias("session_prem"),
    )


def known_entities_only(
    exposures: DataFrame, vehicles: DataFrame, drivers: DataFrame, postal: DataFrame
) -> DataFrame:
    """Exposures whose vehicle has attributes and a postal area, and whose driver has attributes."""
    return (
        exposures.join(vehicles.select("vin"), ["vin"], "left_semi")
        .join(drivers.select("dln"), ["dln"], "left_semi")
        .join(postal.select("vin"), ["vin"], "left_semi")
        .select(*exposures.columns)
    )
