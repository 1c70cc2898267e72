"""Claims, events and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import checks, timeline
from hindcast.operators.reliable import stored
from hindcast.plans import claims, events
from workloads import inputs
from workloads import tables as t
from workloads.ctes import sql
from workloads.registry import query

_LOSSES = ", ".join(f"{c} / 100.0 AS {c}_loss" for c in ("DC", "COMPSP", "APCOLL", "TPL", "AB"))
_SESSION = (
    "policy_num, vin, dln, CAST(term_eff AS VARCHAR) AS term_eff, CAST(term_days AS BIGINT) AS term_days, "
    "CAST(ver_eff AS VARCHAR) AS ver_eff, CAST(ver_exp AS VARCHAR) AS ver_exp, ver_days, "
    "prem / 100.0 AS session_prem"
)


@query("claims_latest", sql("""
SELECT policy_num, int_claim_num, CAST(loss_dt AS VARCHAR) AS loss_dt, cvg, sum(cents) / 100.0 AS loss_sum
FROM claim_latest GROUP BY policy_num, int_claim_num, claim_latest.loss_dt, cvg"""))
def claims_latest(spark, folder):
    rows = t.claim_rows(spark, folder).filter(F.col("line_of_business") == t.CAR_CLAIMS)
    mapped = claims.map_coverages(rows, t.coverage_map(spark))
    return claims.latest_amounts(mapped, t.CLAIM_TIES)


@query("dimension_join", sql("""
SELECT vin, postalcode, CAST(job_closed_dt AS VARCHAR) AS job_closed_dt, province, municipalityname,
  longitude, latitude, area_name, population FROM postal_hist"""))
def dimension_join(spark, folder):
    rows = inputs.postal(spark, folder)
    return rows.withColumn("job_closed_dt", F.date_format("job_closed_dt", "yyyy-MM-dd HH:mm:ss"))


@query("claims_wide", sql(f"""
SELECT policy_num, vin, dln, CAST(loss_dt AS VARCHAR) AS loss_dt, {_LOSSES} FROM claims_wide"""))
def claims_wide(spark, folder):
    return inputs.claims_wide(spark, folder)


@query("claim_counts_by_coverage", sql("""
SELECT cvg, count(DISTINCT (policy_num, int_claim_num)) AS claims FROM claims_long GROUP BY cvg"""))
def claim_counts_by_coverage(spark, folder):
    return claims.claim_counts(inputs.claims_long(spark, folder))


@query("sessions_without_claim", sql(f"SELECT {_SESSION} FROM free_sessions"))
def sessions_without_claim(spark, folder):
    return timeline.sessions_without_event(
        inputs.sessions(spark, folder), inputs.claims_wide(spark, folder), events.PARTY,
        "ver_eff", "ver_exp", "loss_dt",
    )


EVENT_TABLE_SQL = sql(f"""
SELECT policy_num, vin, dln, CAST(ver_eff AS VARCHAR) AS ver_eff, {_LOSSES} FROM events_labelled""")


@query("event_table", EVENT_TABLE_SQL)
def event_table(spark, folder):
    return inputs.labelled(spark, folder)


@query("session_loss", sql(f"""
SELECT {_SESSION}, {", ".join(f"{c} / 100.0 AS session_loss_{c}" for c in t.ALL_COVERAGES)}
FROM session_loss"""))
def session_loss(spark, folder):
    return inputs.session_losses(spark, folder)


_ONE_LOSS = "SELECT policy_num, vin, dln, loss_dt, DC + COMPSP + APCOLL + TPL + AB AS loss FROM claims_wide"
_HITS = """SELECT s.*, c.loss_dt, c.loss FROM sessions s JOIN one_loss c ON c.policy_num = s.policy_num
  AND c.vin = s.vin AND c.dln = s.dln AND c.loss_dt BETWEEN s.ver_eff AND s.ver_exp"""


def _tuples(spark, folder):
    wide = inputs.claims_wide(spark, folder)
    losses = wide.select(*events.PARTY, "loss_dt", events.total_loss().alias("loss"))
    return events.loss_tuples(inputs.sessions(spark, folder), losses)


@query("session_loss_tuples", sql("""
SELECT s.policy_num, s.vin, s.dln, CAST(s.ver_eff AS VARCHAR) AS ver_eff, count(h.loss_dt) AS losses,
  CAST(min(h.loss_dt) AS VARCHAR) AS first_loss_dt,
  CAST(coalesce(sum(h.loss), 0) AS BIGINT) / 100.0 AS loss_sum
FROM sessions s LEFT JOIN hits h ON h.policy_num = s.policy_num AND h.vin = s.vin AND h.dln = s.dln
  AND h.ver_eff = s.ver_eff
GROUP BY s.policy_num, s.vin, s.dln, s.ver_eff""", one_loss=_ONE_LOSS, hits=_HITS))
def session_loss_tuples(spark, folder):
    total = F.aggregate(
        F.transform("loss_tuples", lambda x: x["loss"]), F.lit(0).cast("decimal(38,2)"),
        lambda a, x: (a + x).cast("decimal(38,2)"),
    )
    return _tuples(spark, folder).select(
        "policy_num", "vin", "dln", "ver_eff", F.size("loss_tuples").alias("losses"),
        F.get("loss_tuples", F.lit(0))["loss_dt"].alias("first_loss_dt"), total.alias("loss_sum"),
    )


@query("session_loss_rows", sql("""
SELECT policy_num, vin, dln, CAST(term_eff AS VARCHAR) AS term_eff, CAST(term_days AS BIGINT) AS term_days,
  prem / 100.0 AS session_prem, CAST(loss_dt AS VARCHAR) AS ver_eff, CAST(loss_dt AS VARCHAR) AS ver_exp,
  CAST(1 AS BIGINT) AS ver_days, loss / 100.0 AS session_loss FROM hits
UNION ALL
SELECT policy_num, vin, dln, CAST(term_eff AS VARCHAR), CAST(term_days AS BIGINT), prem / 100.0,
  CAST(ver_eff AS VARCHAR), CAST(ver_exp AS VARCHAR), ver_days, 0.0 FROM free_sessions""",
    one_loss=_ONE_LOSS, hits=_HITS))
def session_loss_rows(spark, folder):
    return events.loss_rows(_tuples(spark, folder))


@query("claim_frequency", sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS cvg, avg(CASE WHEN {c} > 0 THEN 1 ELSE 0 END) AS frequency FROM events_labelled"
    for c in ("DC", "COMPSP", "APCOLL", "TPL", "AB"))))
def claim_frequency(spark, folder):
    return events.claim_frequency(inputs.labelled(spark, folder))


@query("global_ranges", sql("""
SELECT CAST(min(term_eff) AS VARCHAR) AS min_term_eff, CAST(max(term_eff) AS VARCHAR) AS max_term_eff,
  CAST(min(ver_eff) AS VARCHAR) AS min_ver_eff, CAST(max(ver_exp) AS VARCHAR) AS max_ver_exp,
  avg(term_days) AS mean_term_days, CAST(sum(prem) AS BIGINT) / 100.0 AS sum_prem, count(*) AS sessions
FROM sessions"""))
def global_ranges(spark, folder):
    return inputs.sessions(spark, folder).agg(
        F.min("term_eff").alias("min_term_eff"), F.max("term_eff").alias("max_term_eff"),
        F.min("ver_eff").alias("min_ver_eff"), F.max("ver_exp").alias("max_ver_exp"),
        F.avg("term_days").alias("mean_term_days"), F.sum("session_prem").alias("sum_prem"),
        F.count(F.lit(1)).alias("sessions"),
    )


_AS_OF_DRIVER = """SELECT * EXCLUDE (rn) FROM (
  SELECT e.policy_num, e.vin, e.dln, e.ver_eff, d.seq, d.years_licensed, d.disc, d.status,
    row_number() OVER (PARTITION BY e.policy_num, e.vin, e.dln, e.ver_eff ORDER BY d.processed_date DESC,
      d.seq DESC, d.years_licensed DESC, d.disc DESC, d.status DESC) AS rn
  FROM events_labelled e JOIN driver_hist d ON d.dln = e.dln AND d.processed_date < e.ver_eff)
WHERE rn = 1"""
_AS_OF_VEHICLE = """SELECT * EXCLUDE (rn) FROM (
  SELECT e.policy_num, e.vin, e.dln, e.ver_eff, v.job, v.make, v.body_type, v.weight, v.cost_new_amt,
    v.purchased, v.winter_tires,
    row_number() OVER (PARTITION BY e.policy_num, e.vin, e.dln, e.ver_eff ORDER BY v.processed_date DESC,
      v.job DESC, v.body_type DESC, v.cost_new_amt DESC, v.purchased DESC, v.make DESC) AS rn
  FROM events_labelled e JOIN vehicle_hist v ON v.vin = e.vin
    AND v.processed_date < CAST(e.ver_eff AS TIMESTAMP)) WHERE rn = 1"""
_AS_OF_POSTAL = """SELECT * EXCLUDE (rn) FROM (
  SELECT e.policy_num, e.vin, e.dln, e.ver_eff, p.postalcode, p.province, p.municipalityname, p.longitude,
    p.latitude, p.area_name, p.population,
    row_number() OVER (PARTITION BY e.policy_num, e.vin, e.dln, e.ver_eff ORDER BY p.job_closed_dt DESC,
      p.postalcode DESC) AS rn
  FROM events_labelled e JOIN postal_hist p ON p.vin = e.vin
    AND p.job_closed_dt < CAST(e.ver_eff AS TIMESTAMP)) WHERE rn = 1"""
_FAN_IN = dict(as_of_driver=_AS_OF_DRIVER, as_of_vehicle=_AS_OF_VEHICLE, as_of_postal=_AS_OF_POSTAL)
_JOINED = """FROM events_labelled e LEFT JOIN as_of_driver d USING (policy_num, vin, dln, ver_eff)
LEFT JOIN as_of_vehicle v USING (policy_num, vin, dln, ver_eff)
LEFT JOIN as_of_postal p USING (policy_num, vin, dln, ver_eff)"""
_FEATURES = """CAST(seq AS BIGINT) AS seq, years_licensed, disc, status, job, make, body_type,
  CAST(weight AS BIGINT) AS weight, CAST(cost_new_amt AS DOUBLE) AS cost_new_amt,
  winter_tires, postalcode, province, municipalityname, longitude, latitude, area_name, population"""


def _event_keys(spark, folder):
    """Keys of the events, stored because each lookup reads them twice."""
    rows = inputs.labelled(spark, folder)
    return stored(rows.select("policy_num", "vin", "dln", "ver_eff"))


@query("asof_driver_features", sql("""
SELECT policy_num, vin, dln, CAST(ver_eff AS VARCHAR) AS ver_eff, CAST(seq AS BIGINT) AS seq,
  years_licensed, disc, status FROM as_of_driver""", as_of_driver=_AS_OF_DRIVER))
def asof_driver_features(spark, folder):
    keys = _event_keys(spark, folder)
    return timeline.asof_join(
        keys, t.driver_history(spark, folder), ["dln"], "ver_eff", "processed_date", t.DRIVER_TIES
    )


@query("asof_fan_in", sql(f"""
SELECT policy_num, vin, dln, CAST(ver_eff AS VARCHAR) AS ver_eff, {_FEATURES},
  CAST(purchased AS VARCHAR) AS date_purchased {_JOINED}""", **_FAN_IN))
def asof_fan_in(spark, folder):
    keys = _event_keys(spark, folder)
    out = events.attach_histories(keys, inputs.histories(spark, folder))
    return out.withColumn("date_purchased", F.col("date_purchased").cast("date"))


@query("policy_region", sql("SELECT policy_num, prov_cd, policy_province FROM regions"))
def policy_region(spark, folder):
    from hindcast.functions.text import province_group

    return inputs.regions(spark, folder).withColumn("policy_province", province_group("prov_cd"))


@query("assembled_events", sql(f"""
SELECT policy_num, vin, dln, CAST(ver_eff AS VARCHAR) AS ver_eff, {_LOSSES}, {_FEATURES}, policy_province,
  date_diff('day', purchased, ver_eff) AS date_purchased_dayssince,
  CAST(dayofweek(ver_eff) + 1 AS BIGINT) AS ver_eff_dow, CAST(day(ver_eff) AS BIGINT) AS ver_eff_dom,
  CAST(month(ver_eff) AS BIGINT) AS ver_eff_month
{_JOINED} JOIN regions USING (policy_num) WHERE policy_province IN ('ON', 'AB', 'ATL')""", **_FAN_IN))
def assembled_events(spark, folder):
    return inputs.assembled(spark, folder)


@query("quality_checks", sql("""
SELECT 'sessions unique' AS check_name, count(DISTINCT (vin, policy_num, ver_eff)) AS found,
  count(*) AS expected, found = expected AS passed FROM sessions
UNION ALL SELECT 'events unique', count(DISTINCT (policy_num, vin, dln, ver_eff)), count(*),
  count(DISTINCT (policy_num, vin, dln, ver_eff)) = count(*) FROM events_labelled
UNION ALL SELECT 'regions unique', count(DISTINCT policy_num), count(*),
  count(DISTINCT policy_num) = count(*) FROM regions
UNION ALL SELECT 'drivers seen before', (SELECT count(*) FROM as_of_driver), (SELECT count(*) FROM events_labelled),
  (SELECT count(*) FROM as_of_driver) <= (SELECT count(*) FROM events_labelled)
UNION ALL SELECT 'fan-in keeps rows', (SELECT count(*) FROM events_labelled LEFT JOIN as_of_driver
    USING (policy_num, vin, dln, ver_eff)), (SELECT count(*) FROM events_labelled),
  (SELECT count(*) FROM events_labelled LEFT JOIN as_of_driver USING (policy_num, vin, dln, ver_eff))
    = (SELECT count(*) FROM events_labelled)
UNION ALL SELECT 'no null premium', count(*) FILTER (prem IS NULL), 0, count(*) FILTER (prem IS NULL) = 0
  FROM sessions""", as_of_driver=_AS_OF_DRIVER))
def quality_checks(spark, folder):
    sessions = stored(inputs.sessions(spark, folder))
    wide = stored(inputs.claims_wide(spark, folder))  # the labels read it twice
    labelled = stored(events.label_events(sessions, wide))
    keys = labelled.select("policy_num", "vin", "dln", "ver_eff")
    known = timeline.asof_join(
        keys, t.driver_history(spark, folder), ["dln"], "ver_eff", "processed_date", t.DRIVER_TIES
    )
    left = events.attach_histories(keys, inputs.histories(spark, folder))
    return checks.all_checks(
        checks.unique_key(sessions, ["vin", "policy_num", "ver_eff"], "sessions unique"),
        checks.unique_key(labelled, keys.columns, "events unique"),
        checks.unique_key(inputs.regions(spark, folder), ["policy_num"], "regions unique"),
        checks.not_more_keys(known, keys, keys.columns, "drivers seen before"),
        checks.same_row_count(left, keys, "fan-in keeps rows"),
        checks.no_nulls(sessions, ["session_prem"], "no null premium"),
    )
