"""Back-test, lift, rank correlation, cession savings, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import labels, text
from hindcast.functions.types import bool_to_int
from hindcast.operators import ordering
from hindcast.operators.frequency import frequency_encode as encode_frequencies
from hindcast.operators.cleaning import between_dates
from hindcast.operators.reliable import checkpointed, stored
from hindcast.plans import backtest, cession, evaluate, events, splits
from workloads import inputs
from workloads import tables as t
from workloads.ctes import sql
from workloads.registry import query

GROUP = ("as_of", "horizon")


@query("premium_prorated", sql("""
SELECT policy_num, vin, dln, CAST(ver_eff AS VARCHAR) AS ver_eff, CAST(micros AS BIGINT) / 1000000.0 AS part
FROM prem_parts WHERE as_of = DATE '2000-03-01' AND h = 3"""))
def premium_prorated(spark, folder):
    parts = backtest.prorated_premiums(inputs.sessions(spark, folder), "2000-03-01", "2000-05-31")
    return parts.select("policy_num", "vin", "dln", "ver_eff", F.col("prem_segmented_sub").alias("part"))


@query("inforce_scores", sql("SELECT vin, policy_num, dln, mpa_score FROM inforce"))
def inforce_scores(spark, folder):
    return inputs.inforce(spark, folder)


@query("inforce_backtest", sql("""
SELECT policy_num, vin, dln, CAST(as_of AS VARCHAR) AS as_of, * EXCLUDE (policy_num, vin, dln, as_of,
  loss_1, loss_3, loss_6, p1, p3, p6) FROM backtest"""))
def inforce_backtest(spark, folder):
    return inputs.backtested(spark, folder)


_RATIO = (
    "(CAST(sum(loss_{h}) FILTER (mpa_score {op} cut) AS BIGINT) / 100.0)"
    " / (CAST(sum(p{h}) FILTER (mpa_score {op} cut) AS BIGINT) / 1000000.0) AS {side}_{h}"
)


@query("inforce_lift", sql(f"""
SELECT CAST(backtest.as_of AS VARCHAR) AS as_of,
  {", ".join(_RATIO.format(h=h, op=op, side=side) for h in (1, 3, 6) for op, side in ((">=", "top"), ("<", "bottom")))}
FROM backtest JOIN (SELECT as_of, quantile_cont(mpa_score, 0.95) AS cut FROM backtest GROUP BY as_of) USING (as_of)
GROUP BY backtest.as_of"""))
def inforce_lift(spark, folder):
    return backtest.backtest_lift(checkpointed(inputs.backtested(spark, folder)), exact=True)


_INFER = """SELECT policy_num, vin, dln, as_of AS ver_eff, mpa_score, loss_6, p6 FROM backtest"""
_INFER_DRIVER = """SELECT * EXCLUDE (rn) FROM (
  SELECT e.policy_num, e.vin, e.dln, e.ver_eff, d.seq, d.years_licensed, d.disc, d.status,
    row_number() OVER (PARTITION BY e.policy_num, e.vin, e.dln, e.ver_eff ORDER BY d.processed_date DESC,
      d.seq DESC, d.years_licensed DESC, d.disc DESC, d.status DESC) AS rn
  FROM infer e JOIN driver_hist d ON d.dln = e.dln AND d.processed_date < e.ver_eff) WHERE rn = 1"""
_INFER_POSTAL = """SELECT * EXCLUDE (rn) FROM (
  SELECT e.policy_num, e.vin, e.dln, e.ver_eff, p.postalcode, p.municipalityname, p.population,
    row_number() OVER (PARTITION BY e.policy_num, e.vin, e.dln, e.ver_eff ORDER BY p.job_closed_dt DESC,
      p.postalcode DESC) AS rn
  FROM infer e JOIN postal_hist p ON p.vin = e.vin AND p.job_closed_dt < CAST(e.ver_eff AS TIMESTAMP))
WHERE rn = 1"""


@query("inforce_inference", sql("""
SELECT policy_num, vin, dln, CAST(ver_eff AS VARCHAR) AS ver_eff, mpa_score,
  CAST(loss_6 AS BIGINT) / 100.0 AS loss_6, p6 / 1000000.0 AS prem_6, CAST(seq AS BIGINT) AS seq,
  years_licensed, status, postalcode, municipalityname, population, policy_province,
  CAST(month(ver_eff) AS BIGINT) AS ver_eff_month
FROM infer LEFT JOIN infer_driver USING (policy_num, vin, dln, ver_eff)
LEFT JOIN infer_postal USING (policy_num, vin, dln, ver_eff) JOIN regions USING (policy_num)
WHERE policy_province IN ('ON', 'AB', 'ATL')""", infer=_INFER, infer_driver=_INFER_DRIVER, infer_postal=_INFER_POSTAL))
def inforce_inference(spark, folder):
    rows = inputs.backtested(spark, folder).withColumn("loss_6", backtest.horizon_loss(6))
    rows = backtest.inference_events(rows.select(*backtest.PARTY, "as_of", "mpa_score", "loss_6", "prem_6"))
    out = events.assemble(
        rows, inputs.histories(spark, folder), inputs.regions(spark, folder), as_float=False
    )
    return out.select(
        "policy_num", "vin", "dln", "ver_eff", "mpa_score", "loss_6", "prem_6", "seq", "years_licensed",
        "status", "postalcode", "municipalityname", "population", "policy_province", "ver_eff_month",
    )


def _scored(spark, folder):
    """All as-of dates and horizons in long form; checkpointed, as the cut reads it first."""
    rows = inputs.backtested(spark, folder)
    figures = F.array(*[
        F.struct(F.lit(h).cast("bigint").alias("horizon"), backtest.horizon_loss(h).alias("loss"),
                 F.col(f"prem_{h}").alias("prem")) for h in backtest.HORIZONS
    ])
    return checkpointed(
        rows.select("policy_num", "vin", "dln", "as_of", "mpa_score", F.inline(figures)))


_LONG = """
SELECT policy_num, vin, dln, CAST(as_of AS VARCHAR) AS as_of, mpa_score, CAST(h AS BIGINT) AS horizon,
  CASE h WHEN 1 THEN loss_1 WHEN 3 THEN loss_3 ELSE loss_6 END AS loss,
  CASE h WHEN 1 THEN p1 WHEN 3 THEN p3 ELSE p6 END AS p
FROM backtest, (SELECT unnest([1, 3, 6]) AS h)"""
_TOP5 = """SELECT as_of, horizon, quantile_cont(mpa_score, 0.95) AS cut FROM scored GROUP BY ALL"""


def _lift_sql(source: str) -> str:
    return f"""
SELECT as_of, horizon, CAST(sum(loss) FILTER (mpa_score >= cut) AS BIGINT) / 100.0 AS top_loss,
  CAST(sum(p) FILTER (mpa_score >= cut) AS BIGINT) / 1000000.0 AS top_prem, top_loss / top_prem AS top_ratio,
  CAST(sum(loss) FILTER (mpa_score < cut) AS BIGINT) / 100.0 AS bottom_loss,
  CAST(sum(p) FILTER (mpa_score < cut) AS BIGINT) / 1000000.0 AS bottom_prem,
  bottom_loss / bottom_prem AS bottom_ratio
FROM scored JOIN {source} USING (as_of, horizon) GROUP BY as_of, horizon"""


@query("lift_top5", sql(_lift_sql("top5"), scored=_LONG, top5=_TOP5))
def lift_top5(spark, folder):
    return evaluate.lift_top_share(_scored(spark, folder), "mpa_score", "loss", "prem", group=GROUP)


@query("lift_top5_approximate", sql(_lift_sql("cuts"), scored=_LONG, cuts="""
SELECT as_of, horizon, quantile_disc(mpa_score, 0.95) AS cut FROM scored GROUP BY ALL"""))
def lift_top5_approximate(spark, folder):
    """The approximate cut is exact while a group has fewer rows than the accuracy, 10,000."""
    return evaluate.lift_top_share(
        _scored(spark, folder), "mpa_score", "loss", "prem", exact=False, group=GROUP
    )


_AUC = """
SELECT as_of, horizon, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
  SELECT *, sum(neg) OVER (PARTITION BY as_of, horizon ORDER BY mpa_score) - neg AS below FROM (
    SELECT as_of, horizon, mpa_score, coalesce(sum({w}) FILTER (loss > 0), 0)::DOUBLE AS pos,
      coalesce(sum({w}) FILTER (NOT loss > 0), 0)::DOUBLE AS neg FROM scored
    WHERE mpa_score IS NOT NULL AND loss IS NOT NULL AND {w} IS NOT NULL
    GROUP BY as_of, horizon, mpa_score)) GROUP BY as_of, horizon"""


@query("auc_scores", sql("""
SELECT as_of, horizon, round(u.auc, 9) AS auc, round(w.auc, 9) AS weighted_auc
FROM plain u LEFT JOIN weighted w USING (as_of, horizon)""", scored=_LONG, plain=_AUC.format(w="1"),
    weighted=_AUC.format(w="floor(p / 1000000)")))
def auc_scores(spark, folder):
    """How well the score tells rows with a loss from those without, also weighted by premium."""
    rows = _scored(spark, folder).select(
        *GROUP, "mpa_score", (F.col("loss") > 0).cast("int").alias("has_loss"),
        F.floor("prem").alias("weight"))
    plain = evaluate.area_under_curve(rows, "mpa_score", "has_loss", GROUP)
    weighted = evaluate.area_under_curve(rows, "mpa_score", "has_loss", GROUP, "weight")
    return plain.join(weighted.withColumnRenamed("auc", "weighted_auc"), list(GROUP), "left").select(
        *GROUP, F.round("auc", 9).alias("auc"), F.round("weighted_auc", 9).alias("weighted_auc"))


@query("lift_top1_count", sql("""
SELECT as_of, horizon, rn <= n * 0.01 // 1 AS in_top, count(*) AS rows,
  round(avg(CAST(loss AS DOUBLE) / 100.0 / nullif(p / 1000000.0, 0)), 6) AS mean_row_ratio,
  (CAST(sum(loss) AS BIGINT) / 100.0) / (CAST(sum(p) AS BIGINT) / 1000000.0) AS ratio_of_sums,
  (CAST(sum(loss) AS BIGINT) / 100.0) / count(loss) AS mean_loss
FROM ranked GROUP BY 1, 2, 3""", scored=_LONG, ranked="""
SELECT *, row_number() OVER (PARTITION BY as_of, horizon ORDER BY mpa_score DESC NULLS LAST, policy_num, vin, dln)
  AS rn, count(*) OVER (PARTITION BY as_of, horizon) AS n FROM scored"""))
def lift_top1_count(spark, folder):
    out = evaluate.lift_top_rows(
        _scored(spark, folder), "mpa_score", "loss", "prem", ("policy_num", "vin", "dln"),
        group=GROUP,
    )
    return out.withColumn("mean_row_ratio", F.round("mean_row_ratio", 6))


@query("cut_distinct_counts", sql("""
SELECT as_of, horizon, 'top' AS side, count(DISTINCT (vin, policy_num)) AS keys
FROM scored JOIN top5 USING (as_of, horizon) WHERE mpa_score >= cut GROUP BY ALL
UNION ALL
SELECT as_of, horizon, 'bottom', count(DISTINCT (vin, policy_num))
FROM scored JOIN top5 USING (as_of, horizon) WHERE mpa_score < cut GROUP BY ALL""", scored=_LONG, top5=_TOP5))
def cut_distinct_counts(spark, folder):
    rows = evaluate.with_cut(_scored(spark, folder), "mpa_score", group=GROUP)
    return evaluate.distinct_keys_at_cut(
        rows, "mpa_score", F.col("_cut"), ["vin", "policy_num"], GROUP)


@query("quantile_exact", sql("""
SELECT round(quantile_cont(prem / 100.0, 0.95), 6) AS quantile FROM sessions"""))
def quantile_exact(spark, folder):
    found = ordering.exact_quantile(inputs.sessions(spark, folder), "session_prem", 0.95)
    return found.select(F.round("quantile", 6).alias("quantile"))


@query("quantile_approx", sql("""
SELECT quantile_disc(prem, 0.95) / 100.0 AS quantile FROM sessions"""))
def quantile_approx(spark, folder):
    """With an accuracy above the number of sessions the answer is the exact discrete quantile."""
    return ordering.approximate_quantile(
        inputs.sessions(spark, folder), "session_prem", 0.95, accuracy=10_000_000)


_COMPARED = """SELECT *, CAST(policy_num[2:] AS DOUBLE) % 101 AS preds FROM backtest"""


def _compare_sql() -> str:
    parts = []
    for h in (1, 3, 6):
        for s in ("preds", "mpa_score"):
            loss = f"(CAST(loss_{h} AS DOUBLE) / 100.0)"
            margin = f"({loss} - CAST(p{h} AS DOUBLE) / 1000000.0)"

            def ranks(value):
                return (f"rank() OVER (PARTITION BY as_of ORDER BY {value}) "
                        f"+ (count(*) OVER (PARTITION BY as_of, {value}) - 1) / 2.0")

            parts.append(f"""
SELECT CAST(as_of AS VARCHAR) AS as_of, CAST({h} AS BIGINT) AS horizon, '{s}' AS score_name,
  (CAST(sum(loss_{h}) FILTER ({s} >= cut) AS BIGINT) / 100.0) / (CAST(sum(p{h}) FILTER ({s} >= cut) AS BIGINT) / 1000000.0) AS top_ratio,
  (CAST(sum(loss_{h}) FILTER ({s} < cut) AS BIGINT) / 100.0) / (CAST(sum(p{h}) FILTER ({s} < cut) AS BIGINT) / 1000000.0) AS bottom_ratio,
  round(corr(rs, rl), 6) AS rho_loss, round(corr(rs, rm), 6) AS rho_margin
FROM (SELECT *, {ranks(s)} AS rs, {ranks(loss)} AS rl, {ranks(margin)} AS rm FROM compared)
JOIN (SELECT as_of, quantile_cont({s}, 0.95) AS cut FROM compared GROUP BY as_of) USING (as_of)
GROUP BY as_of""")
    return "\nUNION ALL".join(parts)


@query("spearman_scores", sql(_compare_sql(), compared=_COMPARED))
def spearman_scores(spark, folder):
    rows = inputs.backtested(spark, folder)
    rows = rows.withColumns({f"loss_{h}": backtest.horizon_loss(h) for h in backtest.HORIZONS})
    rows = rows.withColumn("preds", F.expr("cast(substr(policy_num, 2) as double) % 101"))
    out = evaluate.compare_scores(
        checkpointed(rows), ["preds", "mpa_score"], backtest.HORIZONS, group=("as_of",))
    return out.withColumns({c: F.round(c, 6) for c in ("rho_loss", "rho_margin")})


_SCORES = """SELECT 'P'||o_custkey AS policy_number, 'V'||(o_custkey % 500) AS veh_vin,
  CAST(o_orderkey % 3 AS INTEGER) AS exposure_number, CAST(date_trunc('year', o_orderdate) AS DATE) AS term_eff_dt,
  CAST(o_orderdate AS DATE) AS ver_eff_dt,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS xgb_freqxsev_comp,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE (o_orderkey % 1000) * 100 END AS xgb_freqxsev_ab,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)
    + CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE (o_orderkey % 1000) * 100 END + (o_custkey % 50) * 100 AS theo
FROM orders"""
_CHARGED = """SELECT 'P'||o_custkey AS policy_number, 'V'||(o_custkey % 500) AS veh_vin,
  CAST(o_orderkey % 3 AS INTEGER) AS exposure_number, CAST(date_trunc('year', o_orderdate) AS DATE) AS term_eff_dt,
  CAST(o_orderdate AS DATE) AS ver_eff_dt, (o_orderkey % 700) * 100 AS ab_prem, o_custkey * 100 AS liab_prem,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) END AS coll_prem,
  (o_orderkey % 700) * 100 + o_custkey * 100 + CASE WHEN o_orderkey % 31 = 0 THEN 0
    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) END AS charged,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus = 'P' END AS comp_only,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Y' ELSE 'N' END AS endt
FROM orders"""
_CEDED = """SELECT * FROM (SELECT s.*, c.* EXCLUDE (policy_number, veh_vin, exposure_number, term_eff_dt, ver_eff_dt),
    row_number() OVER (PARTITION BY s.policy_number, s.veh_vin, s.exposure_number, s.term_eff_dt
      ORDER BY s.ver_eff_dt, charged, theo, ab_prem, coll_prem NULLS FIRST, comp_only NULLS FIRST, endt) AS rn
  FROM scores s JOIN charged_rows c USING (policy_number, veh_vin, exposure_number, term_eff_dt, ver_eff_dt))
WHERE rn = 1 AND comp_only = false AND endt = 'N'"""


def _strict(c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN CAST(sum({c}) AS BIGINT) END"


@query("cession_savings", sql(f"""
SELECT * REPLACE (CAST(term_eff_dt AS VARCHAR) AS term_eff_dt), CASE WHEN exp_savings > 100 THEN 'Y' WHEN exp_savings <= 100 THEN 'N' END AS cede_decision FROM (
SELECT policy_number, veh_vin, term_eff_dt, {_strict("xgb_freqxsev_comp")} / 100.0 AS xgb_freqxsev_comp_sum,
  {_strict("xgb_freqxsev_ab")} / 100.0 AS xgb_freqxsev_ab_sum, {_strict("ab_prem")} / 100.0 AS ab_prem_sum,
  {_strict("liab_prem")} / 100.0 AS liab_prem_sum, {_strict("coll_prem")} / 100.0 AS coll_prem_sum,
  {_strict("theo")} / 100.0 AS "TotalTheoLC_sum", {_strict("charged")} / 100.0 AS "TotalChargedPrem_sum",
  CAST(round_even(CAST(CAST(0.85 AS DECIMAL(4,2)) * (CAST(sum(theo) AS DECIMAL(18,0)) * 100
    - 70 * CAST(sum(charged) AS DECIMAL(18,0)) - 10000 * 100) / 10000 AS DOUBLE), 0) AS DOUBLE) AS exp_savings
FROM ceded GROUP BY policy_number, veh_vin, term_eff_dt)""", scores=_SCORES, charged_rows=_CHARGED, ceded=_CEDED))
def cession_savings(spark, folder):
    return cession.cession_savings(
        t.rsp_scores(spark, folder), t.rsp_inforce(spark, folder), t.ceding_constants(spark),
        "ON", "A", rename={"xgb_lc_comp": "xgb_freqxsev_comp"},
        order_by=("ver_eff_dt", "TotalChargedPrem", "TotalTheoLC"),
    )


@query("frequency_encode", sql("""
SELECT event_id, c.C1_freq FROM clicks e JOIN (SELECT C1, count(*) AS C1_freq FROM clicks GROUP BY C1) c
  ON c.C1 IS NOT DISTINCT FROM e.C1""",
    clicks="SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS C1 FROM events"))
def frequency_encode(spark, folder):
    rows = t.click_log(spark, folder).select("event_id", "C1")
    return encode_frequencies(rows, ["C1"])


@query("loss_labels", sql("""
SELECT policy_num, vin, dln, CAST(ver_eff AS VARCHAR) AS ver_eff, round(ln(1 + l), 9) AS log_label,
  CASE WHEN l = 0 THEN 0.0 WHEN l <= 2000 THEN 1.0 WHEN l <= 10000 THEN 2.0 WHEN l <= 50000 THEN 3.0 ELSE 4.0 END::DOUBLE AS loss_class,
  least(l / 10000, 1.0)::DOUBLE AS capped, round(ln(1 + l) / nullif(ln(1 + p), 0), 9) AS log_ratio,
  CASE WHEN l - p > 10000 THEN 10000.0 WHEN l < p THEN 0.0 ELSE l - p END::DOUBLE AS diff,
  (l + 1) / (p + 1) AS ratio, CAST(CASE WHEN l = 0 OR p >= l THEN 0 ELSE 1 END AS BIGINT) AS above_premium,
  CAST(l >= 2000 AS BIGINT) AS large, CAST(least(CASE WHEN l = 0 THEN 0 ELSE 6 END, 4) AS BIGINT) AS claims,
  CAST(least(ver_days, 1) AS BIGINT) AS exposure, least(l, 200000)::DOUBLE AS amount,
  l / nullif(ver_days, 0) AS pure_premium, 6.0 / nullif(ver_days, 0) AS frequency,
  l / 6.0 AS average_claim, CAST(l > 0 AS BIGINT) AS has_claim
FROM (SELECT *, loss / 100.0 AS l, prem / 100.0 AS p FROM session_loss)"""))
def loss_labels(spark, folder):
    rows = inputs.session_losses(spark, folder)
    total = sum((F.col(f"session_loss_{c}") for c in t.ALL_COVERAGES[1:]), F.col("session_loss_DC"))
    rows = rows.withColumn("l", total)
    return rows.select(
        "policy_num", "vin", "dln", "ver_eff",
        F.round(labels.log_label("l"), 9).alias("log_label"),
        labels.loss_class("l").alias("loss_class"),
        labels.capped_ratio_label("l").alias("capped"),
        F.round(labels.loss_premium_label("l", "session_prem"), 9).alias("log_ratio"),
        labels.regression_target("diff", "l", "session_prem").alias("diff"),
        labels.regression_target("ratio", "l", "session_prem").alias("ratio"),
        labels.class_target("diff", "l", "session_prem").alias("above_premium"),
        labels.threshold_label("l").alias("large"),
        labels.cleaned_claim_count(F.lit(6), F.col("l")).alias("claims"),
        labels.capped_exposure("ver_days").alias("exposure"),
        labels.capped_claim_amount("l").alias("amount"),
        labels.pure_premium("l", "ver_days").alias("pure_premium"),
        labels.claim_frequency(F.lit(6), F.col("ver_days")).alias("frequency"),
        labels.average_claim(F.col("l"), F.lit(6)).alias("average_claim"),
        bool_to_int(F.col("l") > 0).alias("has_claim"),
    )


@query("label_counts", sql("""
SELECT CAST(loss >= 200000 AS BIGINT) AS label, count(*) AS rows FROM session_loss GROUP BY 1"""))
def label_counts(spark, folder):
    rows = inputs.session_losses(spark, folder)
    total = sum((F.col(f"session_loss_{c}") for c in t.ALL_COVERAGES[1:]), F.col("session_loss_DC"))
    return rows.groupBy(labels.threshold_label(total).alias("label")).agg(
        F.count(F.lit(1)).alias("rows")
    )


_SHAPES = "('WAGON','SEDAN','HATCHBACK','PICKUP','CAB','SUPERCAB')"


@query("model_token_split", sql(f"""
SELECT p_partkey, coalesce([w FOR w IN words IF regexp_full_match(w, '[0-9A]WD')][-1], '-') AS wd,
  coalesce([w FOR w IN words IF regexp_full_match(w, '[0-9]DR')][-1], '-') AS dr,
  coalesce([w FOR w IN words IF w IN {_SHAPES}][-1], '-') AS shap,
  array_to_string([w FOR w IN words IF NOT regexp_full_match(w, '[0-9A]WD')
    AND NOT regexp_full_match(w, '[0-9]DR') AND w NOT IN {_SHAPES}], ' ') AS version
FROM model_words""", model_words="""
SELECT p_partkey, [w FOR w IN string_split_regex(upper(p_name)||' '||(p_size % 6)||'DR  '||
  CASE p_size % 4 WHEN 0 THEN 'SEDAN ' WHEN 1 THEN 'WAGON CAB ' ELSE '' END||
  CASE WHEN p_size % 3 = 0 THEN 'AWD' WHEN p_size % 3 = 1 THEN '4WD LX' ELSE 'FWD' END, '\\s+') IF w <> ''] AS words
FROM part"""))
def model_token_split(spark, folder):
    rows = t.models(spark, folder)
    return rows.select("p_partkey", *text.model_tokens(text.strip_quotes("model")))


@query("split_time", sql("""
SELECT policy_num, vin, dln, CAST(ver_eff AS VARCHAR) AS ver_eff, rn > floor(n * 0.9) AS is_validation FROM (
  SELECT *, row_number() OVER (ORDER BY ver_eff, policy_num, vin, dln) AS rn, count(*) OVER () AS n
  FROM events_labelled)"""))
def split_time(spark, folder):
    rows = inputs.labelled(spark, folder).select("policy_num", "vin", "dln", "ver_eff")
    rows = stored(rows)  # the order's borders, the order and the marks each read it
    return splits.time_split(rows, "ver_eff", ["policy_num", "vin", "dln"])


def _bucket(keys: str, seed: int) -> str:
    return f"('0x'||substr(md5(concat_ws('|', '{seed}', {keys})), 1, 8))::BIGINT % 1000"


@query("split_group", sql(f"""
SELECT policy_num, vin, dln, CAST(ver_eff AS VARCHAR) AS ver_eff, {_bucket("vin", 3)} < 100 AS is_validation,
  {_bucket("policy_num, vin, dln, CAST(ver_eff AS VARCHAR)", 0)} < 100 AS is_random
FROM events_labelled"""))
def split_group(spark, folder):
    rows = inputs.labelled(spark, folder).select("policy_num", "vin", "dln", "ver_eff")
    rows = splits.hash_split(rows, ["vin"], seed=3)
    return splits.hash_split(rows, ["policy_num", "vin", "dln", "ver_eff"], name="is_random")


@query("split_dates", sql("""
SELECT 'train' AS part, count(*) AS rows, CAST(sum(prem) AS BIGINT) / 100.0 AS prem FROM sessions WHERE term_eff <= DATE '1999-12-31'
UNION ALL SELECT 'test', count(*), CAST(sum(prem) AS BIGINT) / 100.0 FROM sessions
  WHERE term_eff BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
UNION ALL SELECT 'before', count(*), CAST(sum(prem) AS BIGINT) / 100.0 FROM sessions WHERE ver_eff >= DATE '1996-01-01' AND ver_eff < DATE '1999-12-31'"""))
def split_dates(spark, folder):
    rows = checkpointed(inputs.sessions(spark, folder))  # three parts of it are read
    train, test = splits.split_by_term(rows, t.TRAIN_UNTIL, t.TEST_FROM, t.TEST_UNTIL)
    before = between_dates(rows, "ver_eff", "1996-01-01", "1999-12-31", end_inclusive=False)

    def total(df, part):
        return df.agg(
            F.lit(part).alias("part"), F.count(F.lit(1)).alias("rows"),
            F.sum("session_prem").alias("prem"),
        )

    return total(train, "train").unionByName(total(test, "test")).unionByName(total(before, "before"))
