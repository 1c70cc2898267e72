"""Claim preparation: from claim versions to losses per coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast import COVERAGES
from hindcast.functions.types import as_money
from hindcast.operators.cleaning import (
    DRIVER_NOISE_IDS,
    VEHICLE_NOISE_IDS,
    between_dates,
    drop_noise_ids,
)
from hindcast.operators.latest import latest_per_key
from hindcast.operators.reshape import pivot_sum

CLAIM_KEYS = ("policy_num", "vin", "dln", "loss_dt")
CLAIM_DAY = ("policy_num", "int_claim_num", "loss_dt")
LINE_OF_BUSINESS = "AUTO"
OTHER_COVERAGE = "UIN"


def map_coverages(rows: DataFrame, coverage_map: DataFrame) -> DataFrame:
    """Add the modelled coverage ``cvg``; rows whose line and code are not mapped are dropped."""
    keys = ["line_type", "line_type_desc", "cvg_type_cd"]
    mapping = coverage_map.select(*keys, F.col("modeling_id_cl").alias("cvg"))
    return rows.join(mapping, keys, "inner")


def latest_amounts(rows: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Loss per policy, claim, day and coverage from the latest positive version of each code."""
    versions = rows.filter("incurred_amt > 0").select(
        "policy_num", "int_claim_num", "cvg_type_cd", "loss_dt", "cvg", "processed_date",
        *ties, as_money("incurred_amt").alias("incurred_amt"),
    )
    latest = latest_per_key(
        versions, ["policy_num", "int_claim_num", "cvg_type_cd", "loss_dt"],
        ["processed_date", *ties, "incurred_amt"],
    )
    # one row per code and day is left; spread by claim day, it needs no shuffle for the sum, nor
    # for the join with the parties that follows
    by_claim_day = latest.repartition(*CLAIM_DAY)
    return by_claim_day.groupBy(*CLAIM_DAY, "cvg").agg(
        as_money(F.sum("incurred_amt")).alias("loss_sum")
    )


def claim_parties(
    common: DataFrame,
    driver_noise: Sequence[str] = DRIVER_NOISE_IDS,
    vehicle_noise: Sequence[str] = VEHICLE_NOISE_IDS,
) -> DataFrame:
    """Distinct (policy, claim, day, driver, vehicle) with real ids."""
    real = drop_noise_ids(common, {"dln": driver_noise, "vin": vehicle_noise})
    return real.select("policy_num", "int_claim_num", "loss_dt", "dln", "vin").distinct()


def claims_long(
    coverage_rows: DataFrame,
    common: DataFrame,
    coverage_map: DataFrame | None,
    start: str,
    end: str | None = None,
    ties: Sequence[str] = (),
    line_of_business: str = LINE_OF_BUSINESS,
) -> DataFrame:
    """``policy_num, int_claim_num, loss_dt, cvg, loss_sum, dln, vin`` of losses in the period.

    With a map, only rows of one line of business are mapped and kept. A claim with several driver/vehicle pairs counts its loss once for each pair.
    """
    rows = between_dates(coverage_rows, "loss_dt", start, end)
    if coverage_map is not None:
        rows = map_coverages(rows.filter(F.col("line_of_business") == line_of_business), coverage_map)
    parties = claim_parties(between_dates(common, "loss_dt", start, end))
    return latest_amounts(rows, ties).join(
        parties, list(CLAIM_DAY), "inner"
    )


def claims_wide(claims: DataFrame, coverages: Sequence[str] = COVERAGES) -> DataFrame:
    """One row per policy, vehicle, driver and loss day with one ``<cvg>_loss`` per coverage."""
    return pivot_sum(
        claims.filter(F.col("cvg") != OTHER_COVERAGE), CLAIM_KEYS, "cvg", coverages, "loss_sum",
        suffix="_loss",
    )


def claim_counts(claims: DataFrame) -> DataFrame:
    """Distinct claims per coverage."""
    return claims.groupBy("cvg").agg(
        F.count_distinct("policy_num", "int_claim_num").alias("claims")
    )
