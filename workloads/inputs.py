"""Prepared inputs that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import COVERAGES
from hindcast.operators.reliable import stored
from hindcast.plans import backtest, claims, events, exposure
from hindcast.plans.events import label_events
from workloads import tables as t

LOADED = "loaded_seq"


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return exposure.clean_exposures(t.exposure_sources(spark, folder), *t.PERIOD)


def premiums(spark: SparkSession, folder: str) -> DataFrame:
    return exposure.session_premiums(clean(spark, folder), LOADED)


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return exposure.exposure_sessions(t.exposure_sources(spark, folder), *t.PERIOD, loaded=LOADED)


def claims_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.claim_rows(spark, folder)
    return claims.claims_long(
        rows, rows.filter(F.col("line_of_business") == t.CAR_CLAIMS), t.coverage_map(spark),
        t.CLAIMS_FROM, ties=t.CLAIM_TIES, line_of_business=t.CAR_CLAIMS,
    )


def claims_wide(spark: SparkSession, folder: str) -> DataFrame:
    return claims.claims_wide(claims_long(spark, folder))


def labelled(spark: SparkSession, folder: str, claims_rows: DataFrame | None = None) -> DataFrame:
    """Labelled events; what they are built from is stored, since the labels read it twice.

    ``claims_rows`` is the result of :func:`claims_long`, if the caller has stored it already.
    """
    long = claims_long(spark, folder) if claims_rows is None else claims_rows
    spans = sessions(spark, folder).select(*events.PARTY, "ver_eff", "ver_exp")
    return label_events(stored(spans), stored(claims.claims_wide(long)))


def regions(spark: SparkSession, folder: str) -> DataFrame:
    return events.policy_regions(
        t.policies_old(spark, folder), t.policies_new(spark, folder), t.province_dim(spark, folder)
    )


def postal(spark: SparkSession, folder: str) -> DataFrame:
    return events.postal_features(
        t.vehicle_postal(spark, folder), t.area_map(spark, folder), t.area_facts(spark, folder),
        loads=t.AREA_LOADS,
    )


def histories(spark: SparkSession, folder: str):
    return [
        (t.driver_history(spark, folder), "dln", "processed_date", t.DRIVER_TIES),
        (t.vehicle_history(spark, folder), "vin", "processed_date", ("job",)),
        (postal(spark, folder), "vin", "job_closed_dt", ("postalcode",)),
    ]


def assembled(spark: SparkSession, folder: str) -> DataFrame:
    return events.assemble(
        labelled(spark, folder), histories(spark, folder), regions(spark, folder), as_float=False
    )


def inforce(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.inforce_snapshot(t.inforce_scores(spark, folder))


def backtested(spark: SparkSession, folder: str, as_of=t.AS_OF) -> DataFrame:
    return backtest.inforce_backtest(
        inforce(spark, folder), claims_wide(spark, folder), sessions(spark, folder), as_of
    )


def session_losses(
    spark: SparkSession, folder: str, claims_rows: DataFrame | None = None
) -> DataFrame:
    """Sessions with one loss per coverage, UIN among them; ``claims_rows`` as in :func:`labelled`."""
    long = claims_long(spark, folder) if claims_rows is None else claims_rows
    per_coverage = long.select(
        *events.PARTY, "loss_dt",
        *[
            F.when(F.col("cvg") == c, F.col("loss_sum")).alias(f"session_loss_{c}")
            for c in t.ALL_COVERAGES
        ],
    )
    names = [f"session_loss_{c}" for c in t.ALL_COVERAGES]
    return events.session_losses(stored(sessions(spark, folder)), per_coverage, names)  # read twice


def loss_columns() -> list[str]:
    return [f"{c}_loss" for c in COVERAGES]
