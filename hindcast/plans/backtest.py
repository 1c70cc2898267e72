"""In-force back-test: scores known at a date against losses and premium of the months after it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import COVERAGES
from hindcast.functions.dates import horizon_end, overlaps, prorate
from hindcast.functions.rows import row_sum
from hindcast.operators.ordering import exact_quantiles

HORIZONS = (1, 3, 6)
PARTY = ("policy_num", "vin", "dln")

# The score columns whose sum is the incumbent score, by region.
SCORE_COLUMNS = {
    "AB": ("xgb_freqxsev_pd", "xgb_lc_coll", "xgb_lc_bi", "xgb_lc_comp", "xgb_freqxsev_ab"),
    "ATL": ("xgb_freqxsev_coll", "xgb_freqxsev_ab", "xgb_freqxsev_liab", "xgb_lc_comp",
            "xgb_freqxsev_dc"),
    "ON": ("xgb_lc_coll", "xgb_freqxsev_liab", "xgb_freqxsev_dc", "xgb_freqxsev_ab",
           "xgb_freqxsev_comp"),
    "QC": ("xgb_lc_comp", "xgb_lc_coll", "xgb_lc_liab"),
}
INFORCE_NAMES = {
    "veh_vin": "vin", "policy_number": "policy_num", "term_eff_dt": "term_eff",
    "ver_eff_dt": "ver_eff", "drv_license_number": "dln",
}


def inforce_snapshot(
    raw: DataFrame, region: str = "ON", names: Mapping[str, str] = INFORCE_NAMES
) -> DataFrame:
    """Distinct vehicle, policy, driver and score; a missing part makes the whole score NULL."""
    scores = [F.col(c).try_cast("double") for c in SCORE_COLUMNS[region]]
    keep = [c for c in ("as_of",) if c in raw.columns]
    return (
        raw.withColumnsRenamed(dict(names))
        .select("vin", "policy_num", "dln", row_sum(scores, False).alias("mpa_score"), *keep)
        .distinct()
    )


def prorated_premiums(sessions: DataFrame, on: str | Column, off: str | Column) -> DataFrame:
    """Sessions that touch ``[on, off]`` with the part of their premium that falls in it."""
    on = F.to_date(F.lit(on)) if isinstance(on, str) else on
    off = F.to_date(F.lit(off)) if isinstance(off, str) else off
    part = prorate("session_prem", "ver_days", "ver_eff", "ver_exp", on, off)
    return sessions.filter(overlaps("ver_eff", "ver_exp", on, off)).withColumn(
        "prem_segmented_sub", part
    )


def _dates(as_of: Sequence[str]) -> Column:
    return F.array(*[F.to_date(F.lit(d)) for d in as_of])


def window_losses(
    claims: DataFrame, as_of: Sequence[str], horizons: Sequence[int] = HORIZONS,
    coverages: Sequence[str] = COVERAGES,
) -> DataFrame:
    """Per party and as-of date the losses of each coverage in each horizon, from one aggregation."""
    reach = max(horizons)
    start = F.col("as_of")
    hit = F.filter(
        _dates(as_of),
        lambda d: (F.col("loss_dt") >= d) & (F.col("loss_dt") <= horizon_end(d, reach)),
    )
    sums = [
        F.sum(F.when(F.col("loss_dt") <= horizon_end(start, h), F.col(f"{c}_loss"))).alias(
            f"{c}_loss_{h}"
        )
        for h in horizons
        for c in coverages
    ]
    return claims.withColumn("as_of", F.explode(hit)).groupBy(*PARTY, "as_of").agg(*sums)


def window_premiums(
    sessions: DataFrame, as_of: Sequence[str], horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Per party and as-of date the premium that falls in each horizon.

    Only parties with a session in every horizon are returned.
    """
    reach = max(horizons)
    start = F.col("as_of")
    hit = F.filter(
        _dates(as_of), lambda d: overlaps("ver_eff", "ver_exp", d, horizon_end(d, reach))
    )
    sums, seen = [], F.lit(True)
    for h in horizons:
        off = horizon_end(start, h)
        touches = overlaps("ver_eff", "ver_exp", start, off)
        part = prorate("session_prem", "ver_days", "ver_eff", "ver_exp", start, off)
        sums.append(F.sum(F.when(touches, part)).alias(f"prem_{h}"))
        sums.append(F.count(F.when(touches, 1)).alias(f"_rows_{h}"))
        seen = seen & (F.col(f"_rows_{h}") > 0)
    out = sessions.withColumn("as_of", F.explode(hit)).groupBy(*PARTY, "as_of").agg(*sums)
    return out.filter(seen).drop(*[f"_rows_{h}" for h in horizons])


def inforce_backtest(
    inforce: DataFrame, claims: DataFrame, sessions: DataFrame, as_of: Sequence[str],
    horizons: Sequence[int] = HORIZONS, coverages: Sequence[str] = COVERAGES,
) -> DataFrame:
    """In-force rows with losses (0 when none) and premium per horizon.

    Rows without a score, or without premium in one of the horizons, are not part of the result.
    Without an ``as_of`` column the same in-force table is used for every date.
    """
    if "as_of" not in inforce.columns:
        inforce = inforce.withColumn("as_of", F.explode(_dates(as_of)))
    keys = [*PARTY, "as_of"]
    losses = window_losses(claims, as_of, horizons, coverages)
    premiums = window_premiums(sessions, as_of, horizons)
    names = [f"{c}_loss_{h}" for h in horizons for c in coverages]
    return (
        inforce.dropna(subset=[*PARTY, "mpa_score"])
        .join(premiums, keys, "inner")
        .join(losses, keys, "left")
        .fillna(0, subset=names)
        .select(*keys, "mpa_score", *names, *[f"prem_{h}" for h in horizons])
    )


def horizon_loss(horizon: int, coverages: Sequence[str] = COVERAGES) -> Column:
    return row_sum([f"{c}_loss_{horizon}" for c in coverages], False)


def backtest_lift(
    backtest: DataFrame, horizons: Sequence[int] = HORIZONS, share: float = 0.05,
    coverages: Sequence[str] = COVERAGES, exact: bool = False,
) -> DataFrame:
    """Loss ratios of the top share by score and of the rest, per as-of date and horizon.

    The cut is a quantile of each as-of date, approximate unless asked for exactly.
    """
    if exact:
        cells = backtest.select(
            F.col("as_of").alias("column_name"), F.col("mpa_score").alias("value")
        )
        cuts = exact_quantiles(cells, 1 - share).select(
            F.col("column_name").alias("as_of"), F.col("quantile").alias("_cut")
        )
    else:
        cuts = backtest.groupBy("as_of").agg(
            F.percentile_approx("mpa_score", 1 - share).alias("_cut")
        )
    top = F.col("mpa_score") >= F.col("_cut")
    figures = []
    for h in horizons:
        loss, prem = horizon_loss(h, coverages), F.col(f"prem_{h}")
        for side, rows in (("top", top), ("bottom", ~top)):
            ratio = F.try_divide(
                F.sum(F.when(rows, loss)).cast("double"), F.sum(F.when(rows, prem)).cast("double")
            )
            figures.append(ratio.alias(f"{side}_{h}"))
    return backtest.join(cuts, "as_of").groupBy("as_of").agg(*figures)


def inference_events(backtest: DataFrame) -> DataFrame:
    """Back-test rows as events on their as-of date, ready to be assembled with features."""
    return backtest.withColumn("ver_eff", F.col("as_of"))
