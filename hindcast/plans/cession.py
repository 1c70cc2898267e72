"""Which risks to cede: scores against charged premium per policy, vehicle and term."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.rows import row_sum, strict_sum
from hindcast.functions.savings import cede_decision, expected_savings
from hindcast.operators.cleaning import columns_matching
from hindcast.operators.latest import first_per_key

SCORE_PATTERN = r"^xgb_"
PREMIUM_PATTERN = r"^(ab|ap|liab|dc|coll|comp)_prem$"
RAW_SUFFIX = "raw"
EXPOSURE = ("policy_number", "veh_vin", "exposure_number", "term_eff_dt")


def theoretical_loss(
    scores: DataFrame, rename: Mapping[str, str] | None = None
) -> DataFrame:
    """Scores with their row sum, NULLs counting 0.

    The sum takes in the ``*raw`` columns, which are dropped only afterwards.
    """
    df = scores.withColumnsRenamed(dict(rename or {}))
    parts = columns_matching(df, SCORE_PATTERN)
    kept = columns_matching(df, SCORE_PATTERN, not_ending=RAW_SUFFIX)
    return df.select(
        *EXPOSURE, "ver_eff_dt", *kept, row_sum(parts, True).alias("TotalTheoLC")
    )


def charged_premium(inforce: DataFrame) -> DataFrame:
    parts = columns_matching(inforce, PREMIUM_PATTERN)
    return inforce.select(
        "policy_number", F.col("vin").alias("veh_vin"), "exposure_number", "term_eff_dt",
        "ver_eff_dt", *parts, row_sum(parts, True).alias("TotalChargedPrem"),
        "comprehensive_cov_only", "endt_6a",
    )


def ceding_constants(table: DataFrame, province: str, company: str) -> DataFrame:
    """The one row of cost constants; a missing or second row fails the job that reads it."""
    found = table.filter((F.col("Province") == province) & (F.col("Company") == company))
    one = F.count(F.lit(1)) == 1

    def only(column: str):
        return F.when(one, F.max(column)).otherwise(
            F.raise_error(F.lit(f"need exactly one row of constants for {province}/{company}"))
        ).alias(column)

    return found.agg(*[only(c) for c in ("cession_percent", "annual_pool_cost", "expense_allowance")])


def cession_savings(
    scores: DataFrame, inforce: DataFrame, constants: DataFrame, province: str, company: str,
    rename: Mapping[str, str] | None = None, order_by: Sequence[str] = ("ver_eff_dt",),
) -> DataFrame:
    """Sums and expected savings per policy, vehicle and term.

    Of several versions of an exposure the first by ``order_by`` counts. Comprehensive-only and
    endorsed exposures are left out; a NULL in a summed column makes the sum NULL.
    """
    left, right = theoretical_loss(scores, rename), charged_premium(inforce)
    joined = left.join(right, [*EXPOSURE, "ver_eff_dt"], "inner")
    kept = first_per_key(joined, EXPOSURE, order_by).filter(
        (~F.col("comprehensive_cov_only")) & (F.col("endt_6a") == "N")
    )
    summed = [
        *columns_matching(left, SCORE_PATTERN), *columns_matching(right, PREMIUM_PATTERN),
        "TotalTheoLC", "TotalChargedPrem",
    ]
    sums = kept.groupBy("policy_number", "veh_vin", "term_eff_dt").agg(
        *[strict_sum(c).alias(f"{c}_sum") for c in summed]
    )
    one_row = ceding_constants(constants, province, company)
    value = {
        c: one_row.select(c).scalar()
        for c in ("cession_percent", "expense_allowance", "annual_pool_cost")
    }
    savings = expected_savings(
        "TotalTheoLC_sum", "TotalChargedPrem_sum", value["cession_percent"],
        value["expense_allowance"], value["annual_pool_cost"],
    )
    return sums.withColumn("exp_savings", savings).withColumn(
        "cede_decision", cede_decision("exp_savings")
    )
