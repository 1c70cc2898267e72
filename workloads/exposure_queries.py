"""Cleaning and exposure preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import cleaning, reshape
from hindcast.operators.retro import snapshot_grid
from hindcast.plans import exposure
from workloads import inputs
from workloads import tables as t
from workloads.ctes import sql
from workloads.registry import query

_KEYS = "policy_num, vin, dln, CAST(term_eff AS VARCHAR) AS term_eff, CAST(term_days AS BIGINT) AS term_days"
_SESSION = (
    _KEYS + ", CAST(ver_eff AS VARCHAR) AS ver_eff, CAST(ver_exp AS VARCHAR) AS ver_exp, ver_days"
)


@query("noise_filter", sql("""
SELECT policy_num, vin, dln, loaded_seq, prem_cents / 100.0 AS ft_prem FROM exposure_raw
WHERE vin NOT IN ('', '1234567', '12345678', 'SEARCH', '123456', 'NF')
  AND dln NOT IN ('COMPANY','UNLICENSED','COMPAGNIE','FLEET','$$UNLICENSED','$$COMPANY','1234567',
    '','UNKNOWN','Unknown_DLN')
  AND term_eff BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND prem_cents >= 0"""))
def noise_filter(spark, folder):
    rows = exposure.union_exposures(t.exposure_sources(spark, folder))
    rows = cleaning.drop_noise_ids(
        rows, {"vin": cleaning.VEHICLE_NOISE_IDS, "dln": cleaning.DRIVER_NOISE_IDS}
    )
    rows = cleaning.between_dates(rows, "term_eff", "1996-01-01", "2000-12-31")
    return cleaning.project(
        rows.filter("ft_prem >= 0"), ["policy_num", "vin", "dln", "loaded_seq", "ft_prem"]
    )


@query("exposure_union", sql(f"""
SELECT {_SESSION}, driver_type, CAST(expos_num AS BIGINT) AS expos_num, loaded_seq,
  prem_cents / 100.0 AS ft_prem FROM exposure_clean"""))
def exposure_union(spark, folder):
    return inputs.clean(spark, folder)


@query("exposure_consistent", sql(f"""
SELECT {_SESSION}, driver_type, CAST(expos_num AS BIGINT) AS expos_num, loaded_seq,
  prem_cents / 100.0 AS ft_prem FROM exposure_consistent"""))
def exposure_consistent(spark, folder):
    return exposure.consistent_exposures(inputs.clean(spark, folder))


@query("exposure_sessions", sql(f"SELECT {_SESSION}, prem / 100.0 AS session_prem FROM sessions"))
def exposure_sessions(spark, folder):
    return inputs.sessions(spark, folder)


@query("exposure_bundle", sql(f"""
SELECT {_KEYS}, CAST(min(ver_eff) AS VARCHAR) AS ver_eff, CAST(max(ver_exp) AS VARCHAR) AS ver_exp,
  CAST(sum(ver_days) AS BIGINT) AS ver_days, sum(prem) / 100.0 AS session_prem
FROM sessions GROUP BY ALL"""))
def exposure_bundle(spark, folder):
    return exposure.bundle_terms(inputs.sessions(spark, folder))


@query("driver_type_premium", sql("""
SELECT policy_num, vin, CAST(term_eff AS VARCHAR) AS term_eff, CAST(term_days AS BIGINT) AS term_days,
  CAST(ver_eff AS VARCHAR) AS ver_eff, CAST(ver_exp AS VARCHAR) AS ver_exp, ver_days,
  arg_max(dln, loaded_seq) FILTER (driver_type = 'primary') AS dln_primary,
  arg_max(dln, loaded_seq) FILTER (driver_type = 'iso') AS dln_iso,
  arg_max(dln, loaded_seq) FILTER (driver_type = 'secondary') AS dln_secondary,
  (arg_max(prem, loaded_seq) FILTER (driver_type = 'primary')
   + coalesce(arg_max(prem, loaded_seq) FILTER (driver_type = 'iso'), 0)) / 100.0 AS session_prem
FROM session_premiums
GROUP BY policy_num, vin, session_premiums.term_eff, session_premiums.term_days,
  session_premiums.ver_eff, session_premiums.ver_exp, ver_days
HAVING count(*) FILTER (driver_type = 'primary') > 0"""))
def driver_type_premium(spark, folder):
    return exposure.premium_by_driver_type(inputs.premiums(spark, folder), inputs.LOADED)


@query("known_entities_only", sql(f"""
SELECT {_SESSION}, prem / 100.0 AS session_prem FROM sessions s
WHERE EXISTS (SELECT 1 FROM vehicle_hist v WHERE v.vin = s.vin)
  AND EXISTS (SELECT 1 FROM driver_hist d WHERE d.dln = s.dln)
  AND EXISTS (SELECT 1 FROM postal_hist p WHERE p.vin = s.vin)"""))
def known_entities_only(spark, folder):
    return exposure.known_entities_only(
        inputs.sessions(spark, folder), t.vehicle_history(spark, folder),
        t.driver_history(spark, folder), inputs.postal(spark, folder),
    )


@query("top_keys_by_dates", sql("""
SELECT dln, count(DISTINCT processed_date) AS dates FROM driver_hist GROUP BY dln
ORDER BY dates DESC, dln LIMIT 20"""))
def top_keys_by_dates(spark, folder):
    counted = t.driver_history(spark, folder).groupBy("dln").agg(
        F.count_distinct("processed_date").alias("dates")
    )
    return counted.orderBy(F.desc("dates"), "dln").limit(20)


@query("snapshot_grid", sql("""
SELECT vin, CAST(dt AS VARCHAR) AS dt FROM (SELECT DISTINCT vin FROM claims_long), month_ends"""))
def grid(spark, folder):
    return snapshot_grid(inputs.claims_long(spark, folder), "vin", t.CALENDAR)


_PROFILED = ("policy_num", "vin", "dln", "term_eff", "term_days", "driver_type", "expos_num")


@query("column_profile", sql(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_ratio, "
        f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values FROM profiled"
        for c in _PROFILED
    ),
    profiled="""SELECT * REPLACE (CASE WHEN expos_num = 2 THEN NULL ELSE expos_num END AS expos_num)
      FROM exposure_raw""",
))
def column_profile(spark, folder):
    rows = exposure.union_exposures(t.exposure_sources(spark, folder))
    rows = rows.withColumn("expos_num", F.expr("nullif(expos_num, 2)"))
    return cleaning.column_profile(rows, _PROFILED)


@query("column_profile_approximate")
def column_profile_approximate(spark, folder):
    rows = exposure.union_exposures(t.exposure_sources(spark, folder))
    return cleaning.column_profile(rows, approximate=True)


def _with_poor_columns(spark, folder):
    rows = exposure.union_exposures(t.exposure_sources(spark, folder))
    return rows.select(
        "policy_num", "vin", "dln", "expos_num", "driver_type", F.lit("auto").alias("company"),
        F.lit(None).cast("string").alias("veh_type"),
        F.when(F.col("loaded_seq") == 0, F.col("vin")).alias("dln_prov"),
    )


@query("low_information", sql("""
SELECT * FROM (VALUES ('company', true), ('veh_type', true)) v(column_name, low_information)
UNION ALL SELECT 'dln_prov', (count(*) - count(*) FILTER (loaded_seq = 0)) >= 0.999 * count(*)
  FROM exposure_raw
UNION ALL SELECT 'policy_num', count(DISTINCT policy_num) = 1 FROM exposure_raw
UNION ALL SELECT 'vin', count(DISTINCT vin) = 1 FROM exposure_raw
UNION ALL SELECT 'dln', count(DISTINCT dln) = 1 FROM exposure_raw
UNION ALL SELECT 'expos_num', count(DISTINCT expos_num) = 1 FROM exposure_raw
UNION ALL SELECT 'driver_type', count(DISTINCT driver_type) = 1 FROM exposure_raw"""))
def low_information(spark, folder):
    return cleaning.low_information_columns(_with_poor_columns(spark, folder))


@query("prune_low_information", sql("""
SELECT policy_num, vin, dln, CAST(expos_num AS BIGINT) AS expos_num, driver_type FROM exposure_raw"""))
def prune_low_information(spark, folder):
    return cleaning.prune_low_information(_with_poor_columns(spark, folder))


@query("premium_describe")
def premium_describe(spark, folder):
    return cleaning.describe(inputs.sessions(spark, folder), ["session_prem", "ver_days"])


@query("date_parts", sql("""
SELECT DISTINCT CAST(ver_eff AS VARCHAR) AS ver_eff, CAST(dayofweek(ver_eff) + 1 AS BIGINT) AS ver_eff_dow,
  CAST(day(ver_eff) AS BIGINT) AS ver_eff_dom, CAST(month(ver_eff) AS BIGINT) AS ver_eff_month
FROM exposure_raw"""))
def date_parts(spark, folder):
    from hindcast.functions.dates import date_parts as parts

    rows = exposure.union_exposures(t.exposure_sources(spark, folder))
    return rows.select("ver_eff").distinct().select("ver_eff", *parts("ver_eff"))


@query("days_since", sql("""
SELECT vin, CAST(job AS BIGINT) AS job, CAST(processed_date AS DATE)::VARCHAR AS event_date,
  date_diff('day', purchased, CAST(processed_date AS DATE)) AS date_purchased_dayssince,
  date_diff('day', CAST(processed_date AS DATE), DATE '2022-11-16') AS processed_on_diff
FROM vehicle_hist"""))
def days_since(spark, folder):
    rows = t.vehicle_history(spark, folder).select(
        "vin", "job", F.col("processed_date").cast("date").alias("event_date"), "date_purchased",
        F.col("processed_date").cast("date").alias("processed_on"),
    )
    rows = cleaning.timestamps_to_days(rows, "event_date")
    return cleaning.days_before_reference(
        rows, ["processed_on", "iso_transfer_date"], "2022-11-16"
    )


@query("month_windows", sql("""
SELECT DISTINCT CAST(ver_exp AS VARCHAR) AS ver_exp, CAST(ver_exp - to_months(1) AS DATE)::VARCHAR AS back_1,
  CAST(ver_exp - to_months(6) AS DATE)::VARCHAR AS back_6,
  CAST(ver_exp - to_months(25) AS DATE)::VARCHAR AS back_25,
  CAST(ver_exp + to_months(3) - INTERVAL 1 DAY AS DATE)::VARCHAR AS horizon_3
FROM exposure_raw"""))
def month_windows(spark, folder):
    from hindcast.functions.dates import horizon_end, months_back

    rows = exposure.union_exposures(t.exposure_sources(spark, folder)).select("ver_exp").distinct()
    return rows.select(
        "ver_exp", *[months_back("ver_exp", m).alias(f"back_{m}") for m in (1, 6, 25)],
        horizon_end("ver_exp", 3).alias("horizon_3"),
    )


@query("reshape_columns", sql("""
SELECT policy_num, vin, source, CAST(DC_loss_3 AS DOUBLE) AS DC_loss_3, kind, value FROM (
  SELECT policy_num, vin, 'claims' AS source, DC / 100.0 AS DC_loss_3, 'AB_loss' AS kind, AB / 100.0 AS value
  FROM claims_wide
  UNION ALL SELECT policy_num, vin, 'claims', DC / 100.0, 'TPL_loss', TPL / 100.0 FROM claims_wide)"""))
def reshape_columns(spark, folder):
    wide = inputs.claims_wide(spark, folder)
    wide = reshape.suffix_columns(wide, ["DC_loss"], "_3")
    wide = cleaning.exclude_features(wide, ["COMPSP_", "APCOLL_"])
    wide = cleaning.project(
        wide, drop=["dln", "loss_dt", "not_there"], constants={"source": F.lit("claims")}
    )
    long = reshape.unpivot_scores(
        wide, ["policy_num", "vin", "source", "DC_loss_3"], ["AB_loss", "TPL_loss"], "kind", "value"
    )
    return long
