"""The event table: one labelled row per policy, vehicle, driver and date, and its features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast import COVERAGES, EVENT_KEYS
from hindcast.functions.dates import date_parts
from hindcast.functions.text import province_group
from hindcast.operators.cleaning import narrow_numbers, timestamps_to_days
from hindcast.operators.latest import latest_per_key
from hindcast.operators.reliable import stored
from hindcast.operators.timeline import (
    asof_lookups,
    events_and_free_sessions,
    match_sessions,
    session_sums,
)

PARTY = ("policy_num", "vin", "dln")
# The regions that are modelled, and attributes that never become features.
MODELLED_REGIONS = ("ON", "AB", "ATL")
UNUSED_ATTRIBUTES = (
    "vehNum_riskId", "expos_num", "vehicle_description", "fixed_id", "garage_location_public_id",
    "rsp_ceded",
)


def loss_columns(coverages: Sequence[str] = COVERAGES) -> list[str]:
    return [f"{c}_loss" for c in coverages]


def label_events(
    sessions: DataFrame, claims: DataFrame, coverages: Sequence[str] = COVERAGES
) -> DataFrame:
    """Every claim day with its losses, and every session without a claim as a row of zeros.

    ``claims`` is wide. A claim on a day that two sessions share counts for both; claims that fall
    in no session stay.
    """
    return events_and_free_sessions(
        sessions, claims, PARTY, "ver_eff", "ver_exp", "loss_dt", loss_columns(coverages)
    )


def session_losses(
    sessions: DataFrame, claims: DataFrame, amounts: Sequence[str]
) -> DataFrame:
    """Sessions with the sum of each amount over the claims that fall in them."""
    return session_sums(sessions, claims, PARTY, "ver_eff", "ver_exp", "loss_dt", amounts)


def loss_tuples(sessions: DataFrame, claims: DataFrame, amount: str = "loss") -> DataFrame:
    """Sessions with an array of (date, loss), oldest first; empty for sessions without a loss.

    An array has at most one entry per day of its session.
    """
    return match_sessions(
        sessions, claims, PARTY, "ver_eff", "ver_exp", "loss_dt", [amount]
    ).select(
        *sessions.columns,
        F.transform(
            "hits", lambda h: F.struct(h["loss_dt"].alias("loss_dt"), h[amount].alias("loss"))
        ).alias("loss_tuples"),
    )


def loss_rows(tuples: DataFrame) -> DataFrame:
    """One row per loss, as a session of that one day; sessions without a loss stay as they are."""
    loss = F.explode_outer("loss_tuples").alias("hit")
    hit = F.col("hit").isNotNull()
    rest = [c for c in tuples.columns if c not in {"loss_tuples", "ver_eff", "ver_exp", "ver_days"}]
    return tuples.select("*", loss).select(
        *rest,
        F.when(hit, F.col("hit.loss_dt")).otherwise(F.col("ver_eff")).alias("ver_eff"),
        F.when(hit, F.col("hit.loss_dt")).otherwise(F.col("ver_exp")).alias("ver_exp"),
        F.when(hit, F.lit(1)).otherwise(F.col("ver_days")).alias("ver_days"),
        F.coalesce("hit.loss", F.lit(0)).alias("session_loss"),
    )


def claim_frequency(events: DataFrame, coverages: Sequence[str] = COVERAGES) -> DataFrame:
    """Share of events with a loss, per coverage, from one pass over the events."""
    shares = [
        F.struct(
            F.lit(c).alias("cvg"),
            F.avg(F.when(F.col(f"{c}_loss") > 0, 1).otherwise(0)).alias("frequency"),
        )
        for c in coverages
    ]
    return events.agg(F.array(*shares).alias("s")).select(F.inline("s"))


def total_loss(coverages: Sequence[str] = COVERAGES):
    return reduce(add, [F.col(c) for c in loss_columns(coverages)])


def policy_regions(
    old: DataFrame, new: DataFrame, province_dim: DataFrame
) -> DataFrame:
    """One province per policy from two systems; the new system wins, then the larger code.

    The old system holds a number that ``province_dim`` (``prov_code, prov_abbrev``) translates.
    """
    translate = province_dim.select(
        F.col("prov_code").alias("prov_cd"), F.col("prov_abbrev")
    ).distinct()
    before = (
        old.select("policy_num", "prov_cd")
        .join(translate, ["prov_cd"], "inner")
        .select("policy_num", F.col("prov_abbrev").alias("prov_cd"), F.lit(0).alias("_rank"))
    )
    after = new.select("policy_num", "prov_cd", F.lit(1).alias("_rank"))
    both = before.unionByName(after)
    return latest_per_key(both, ["policy_num"], ["_rank", "prov_cd"]).drop("_rank")


def postal_features(
    postal: DataFrame, area_map: DataFrame, area_facts: DataFrame,
    loads: Sequence[str] = (),
) -> DataFrame:
    """Census facts of the areas in which vehicles were garaged, stamped with the job date.

    ``loads`` names columns of ``area_facts`` that only tell when they were loaded; they are dropped.
    """
    facts = area_facts.drop(*loads)
    areas = area_map.join(facts, ["da"], "inner").select(
        "postalcode", "province", "municipalityname", "longitude", "latitude",
        *[c for c in facts.columns if c != "da"],
    )
    return postal.join(areas, ["postalcode"], "inner").distinct()


def attach_histories(
    events: DataFrame,
    histories: Sequence[tuple[DataFrame, str, str, Sequence[str]]],
    unused: Sequence[str] = UNUSED_ATTRIBUTES,
) -> DataFrame:
    """Add the newest attributes known before each event, from several histories.

    A history is ``(rows, key, time column, ties)``. Unused attributes are dropped before the joins,
    so names that occur in two histories do not collide. Events without history keep NULLs.

    Histories of one key are looked up together. Every lookup starts from the events as given, not
    from the result of the one before, so their plan is read once per key, and once for the joins,
    and does not double with each.
    """
    by_key: dict[str, list] = {}
    names = list(events.columns)
    for history, key, time, ties in histories:
        used = history.drop(*unused)
        by_key.setdefault(key, []).append((used, time, [t for t in ties if t not in unused]))
        names += [c for c in used.columns if c not in {key, time}]
    out = events
    for key, group in by_key.items():
        found = asof_lookups(events, group, [key], "ver_eff")
        added = [c for c in found.columns if c not in {key, "ver_eff"}]
        out = out.join(found, [key, "ver_eff"], "left").select(*out.columns, *added)
    return out.select(*names)


def add_region(
    events: DataFrame, regions: DataFrame, keep: Sequence[str] = MODELLED_REGIONS
) -> DataFrame:
    """Region of the policy; events of other regions or of unknown policies are dropped."""
    grouped = regions.select(
        "policy_num", province_group("prov_cd").alias("policy_province")
    ).filter(F.col("policy_province").isin(*keep))
    return events.join(grouped, ["policy_num"], "inner")


def add_date_features(events: DataFrame, as_float: bool = True) -> DataFrame:
    """Timestamps as days before the event, parts of the event date, and 32-bit numbers."""
    df = timestamps_to_days(events, "ver_eff")
    df = df.select("*", *date_parts("ver_eff"))
    return narrow_numbers(df) if as_float else df


def assemble(
    events: DataFrame,
    histories: Sequence[tuple[DataFrame, str, str, Sequence[str]]],
    regions: DataFrame,
    as_float: bool = True,
) -> DataFrame:
    """Features known before each event: histories, region and dates.

    The region filter runs first, so rows that it drops are not looked up. The events are then
    stored: they are read once per key of the histories, for its columns alone, and are narrow
    compared with what built them.
    """
    kept = stored(add_region(events, regions))
    return add_date_features(attach_histories(kept, histories), as_float)
