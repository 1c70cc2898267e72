"""Feature store: retro windows, nested views, lookups, earlier terms."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from hindcast.operators.reliable import checkpointed, scratch_folder, stored
from hindcast.operators.retro import EXPOSURE_WINDOWS, retro_losses_long
from hindcast.plans import history, store
from hindcast.sources import read_table
from workloads import inputs
from workloads import tables as t
from workloads.ctes import sql
from workloads.registry import query

COVERAGES = ("DC", "COMPSP", "APCOLL", "TPL", "AB")


def _claim_store(spark, folder, kk):
    return store.claim_store(inputs.claims_long(spark, folder), kk, t.CALENDAR)


def _listed(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query("retro_loss_store", sql("""
SELECT vin, cvg, CAST(dt AS VARCHAR) AS dt, array_to_string(bins, ',') AS bins,
  array_to_string(acum, ',') AS acum FROM store_vin"""))
def retro_loss_store(spark, folder):
    return _claim_store(spark, folder, "vin").select(
        "vin", "cvg", "dt", _listed("bins").alias("bins"), _listed("acum").alias("acum")
    )


@query("retro_loss_bins", sql("""
SELECT dln, cvg, CAST(m AS BIGINT) AS months_back, count(*) AS snapshots, CAST(sum(bin) AS BIGINT) AS loss
FROM retro_dln WHERE bin > 0 GROUP BY dln, cvg, m"""))
def retro_loss_bins(spark, folder):
    long = retro_losses_long(_claim_store(spark, folder, "dln"), "dln", "bins")
    return long.groupBy("dln", "cvg", "months_back").agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("loss").alias("loss")
    )


@query("retro_loss_accum", sql("""
SELECT policy_num, cvg, CAST(m AS BIGINT) AS months_back, count(*) AS snapshots, CAST(sum(acum) AS BIGINT) AS loss
FROM retro_policy_num WHERE acum > 0 GROUP BY policy_num, cvg, m""",
    daily_policy_num="""SELECT policy_num, cvg, loss_dt, sum(loss) AS loss FROM (
      SELECT DISTINCT policy_num, cvg, int_claim_num, loss_dt, loss FROM claims_long
      WHERE cvg <> 'UIN') GROUP BY ALL""",
    retro_policy_num="""SELECT policy_num, cvg, dt, m, CAST(sum(loss) // 100 AS BIGINT) AS acum
      FROM daily_policy_num JOIN retro_windows ON loss_dt >= lo AND loss_dt < dt GROUP BY ALL"""))
def retro_loss_accum(spark, folder):
    long = retro_losses_long(_claim_store(spark, folder, "policy_num"), "policy_num", "acum")
    return long.groupBy("policy_num", "cvg", "months_back").agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("loss").alias("loss")
    )


_VAR = "CASE WHEN count({0}) > 1 THEN (count({0})::HUGEINT * sum({0}::HUGEINT * {0}) - sum({0}::HUGEINT) * sum({0}::HUGEINT)) // (count({0})::HUGEINT * (count({0}) - 1) * {1}) ELSE 0 END"


EXPOSURE_CTES = {"exposure_windows": f"""
SELECT dt, CAST(x[1] AS BIGINT) AS near_months, CAST(x[2] AS BIGINT) AS far_months,
  CAST(dt - to_months(x[2]) AS DATE) AS lo, CAST(dt - to_months(x[1]) AS DATE) AS hi
FROM month_ends, (SELECT unnest({[list(w) for w in EXPOSURE_WINDOWS]}) AS x)"""}
for _kk, _a, _b in (("dln", "vin", "policy_num"), ("vin", "dln", "policy_num")):
    EXPOSURE_CTES[f"exposure_store_{_kk}"] = f"""
SELECT s.{_kk}, CAST(w.dt AS VARCHAR) AS dt, near_months, far_months,
  CAST(sum(prem) // 100 AS BIGINT) AS prem_sum,
  CAST({_VAR.format("prem", 10000)} AS BIGINT) AS prem_var,
  CAST(sum(prem) // (100 * count(prem)) AS BIGINT) AS prem_mean,
  CAST(sum(ver_days) // count(ver_days) AS BIGINT) AS days_mean,
  CAST({_VAR.format("ver_days", 1)} AS BIGINT) AS days_var,
  count(DISTINCT {_a}) AS cntdist_{_a}, count(DISTINCT {_b}) AS cntdist_{_b},
  count(DISTINCT term_eff) AS cntdist_term_eff, count(DISTINCT ver_eff) AS cntdist_ver_eff
FROM sessions s JOIN exposure_windows w ON w.lo <= s.ver_eff AND w.hi > s.ver_exp
GROUP BY s.{_kk}, w.dt, near_months, far_months"""


@query("retro_exposure_windows", sql("SELECT * FROM exposure_store_dln", **EXPOSURE_CTES))
def retro_exposure_windows(spark, folder):
    sessions = checkpointed(inputs.sessions(spark, folder))  # read twice
    return store.exposure_store(sessions, "dln", t.CALENDAR)


def _digest(nested, *keys):
    """Snapshots, features and their total of each row's nested map."""
    inner = F.flatten(F.transform(F.map_values("properties"), F.map_values))
    return nested.select(
        *keys, F.size("properties").alias("snapshots"), F.size(inner).alias("features"),
        F.aggregate(inner, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
    )


@query("feature_store_nested", sql("""
SELECT vin, cvg, count(*) AS snapshots, CAST(sum(len(list_filter(bins, lambda x: x > 0))
    + len(list_filter(acum, lambda x: x > 0))) AS BIGINT) AS features,
  CAST(sum(list_sum(bins)) + sum(list_sum(acum)) AS BIGINT) AS total
FROM store_vin GROUP BY vin, cvg"""))
def feature_store_nested(spark, folder):
    stored = checkpointed(_claim_store(spark, folder, "vin"))
    nested = [store.nested_claim_store(stored, "vin", c).withColumn("cvg", F.lit(c))
              for c in COVERAGES]
    return _digest(reduce(lambda a, b: a.unionByName(b), nested), "vin", "cvg")


def _exposure_digest(kk: str) -> str:
    others = [k for k in ("vin", "dln", "policy_num") if k != kk]
    figures = ["prem_sum", "prem_var", "prem_mean", "days_mean", "days_var", "cntdist_term_eff",
               "cntdist_ver_eff", *[f"cntdist_{k}" for k in others]]
    return (f"SELECT {kk}, count(DISTINCT dt) AS snapshots, count(*) * {len(figures)} AS features, "
            f"CAST(sum({' + '.join(f'{f}::HUGEINT' for f in figures)}) AS BIGINT) AS total "
            f"FROM exposure_store_{kk} GROUP BY {kk}")


@query("feature_store_exposure_nested", sql(_exposure_digest("dln"), **EXPOSURE_CTES))
def feature_store_exposure_nested(spark, folder):
    sessions = checkpointed(inputs.sessions(spark, folder))
    stored = store.exposure_store(sessions, "dln", t.CALENDAR)
    return _digest(store.nested_exposure_store(stored, "dln"), "dln")


@query("feature_store_exposure_saved", sql(_exposure_digest("vin"), **EXPOSURE_CTES))
def feature_store_exposure_saved(spark, folder):
    """Both id kinds saved, one of them loaded: only its partition is read."""
    sessions = checkpointed(inputs.sessions(spark, folder))
    root = scratch_folder(sessions)
    for kk in ("vin", "dln"):
        store.save_exposure_store(store.exposure_store(sessions, kk, t.CALENDAR), kk, root)
    return _digest(
        store.nested_exposure_store(store.load_exposure_store(spark, "vin", root), "vin"), "vin")


@query("feature_store_claim_saved", sql("""
SELECT vin, cvg, CAST(dt AS VARCHAR) AS dt, CAST(list_sum(bins) AS BIGINT) AS bin_total,
  CAST(list_sum(acum) AS BIGINT) AS acum_total FROM store_vin"""))
def feature_store_claim_saved(spark, folder):
    stored = checkpointed(_claim_store(spark, folder, "vin"))
    root = scratch_folder(stored)
    store.save_claim_store(stored, "vin", root)
    store.save_claim_store(stored.filter("cvg = 'DC'"), "vin", root)  # a rerun of one coverage

    def total(column: str):
        return F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return store.load_claim_store(spark, "vin", root).select(
        "vin", "cvg", F.col("dt").cast("date").alias("dt"), total("bins").alias("bin_total"),
        total("acum").alias("acum_total"))


def _events(spark, folder, claims_rows=None):
    rows = inputs.labelled(spark, folder, claims_rows)
    return rows.select("policy_num", "vin", "dln", "ver_eff")


_ENDS = [(kind, c, m) for c in COVERAGES for kind, m in (("bin", 0), ("acum", 24))]


@query("store_lookup_nested", sql(
    "SELECT e.policy_num, e.vin, e.dln, CAST(ver_eff AS VARCHAR) AS ver_eff, "
    + ", ".join(f"coalesce({c}.{store.KINDS[kind]}[{m + 1}], 0) AS {c}_{kind}"
                for kind, c, m in _ENDS)
    + ", CAST(" + " + ".join(f"coalesce(list_sum({c}.{f}), 0)" for c in COVERAGES
                             for f in store.KINDS.values()) + " AS BIGINT) AS total"
    + " FROM (SELECT policy_num, vin, dln, ver_eff FROM events_labelled) e "
    + " ".join(f"ASOF LEFT JOIN (SELECT * FROM store_vin WHERE cvg = '{c}') {c} "
               f"ON {c}.vin = e.vin AND {c}.dt <= e.ver_eff" for c in COVERAGES)))
def store_lookup_nested(spark, folder):
    """The lookup on the nested form: newest snapshot, maps merged, vector, named columns.

    ``total`` is over all features of the merged map; the vector names two of each coverage.
    """
    stored = checkpointed(_claim_store(spark, folder, "vin"))
    events = checkpointed(_events(spark, folder))  # read twice
    nested = {c: store.nested_claim_store(stored, "vin", c) for c in COVERAGES}
    names = [store.loss_feature("vin", kind, c, m) for kind, c, m in _ENDS]
    rows = store.nested_features(events, nested, "vin", names, "total")
    return rows.withColumnsRenamed(dict(zip(names, (f"{c}_{kind}" for kind, c, _ in _ENDS))))


def _wide(kk: str, c: str) -> str:
    return ", ".join(
        f"coalesce({kk}_{c}.{field}[{m + 1}], 0) AS {store.loss_feature(kk, kind, c, m)}"
        for m in range(25)
        for kind, field in store.KINDS.items()
    )


_POINT_IN_TIME = sql(
    "SELECT e.policy_num, e.vin, e.dln, CAST(e.ver_eff AS VARCHAR) AS ver_eff,\n"
    + ",\n".join(_wide(kk, c) for kk in ("vin", "dln") for c in COVERAGES)
    + "\nFROM (SELECT policy_num, vin, dln, ver_eff FROM events_labelled) e\n"
    + "\n".join(
        f"ASOF LEFT JOIN (SELECT * FROM store_{kk} WHERE cvg = '{c}') {kk}_{c} "
        f"ON {kk}_{c}.{kk} = e.{kk} AND {kk}_{c}.dt <= e.ver_eff"
        for kk in ("vin", "dln") for c in COVERAGES
    ))


@query("point_in_time_features", _POINT_IN_TIME)
def point_in_time_features(spark, folder):
    claims = checkpointed(inputs.claims_long(spark, folder))
    stores = {kk: store.claim_store(claims, kk, t.CALENDAR) for kk in ("vin", "dln")}
    events = checkpointed(_events(spark, folder, claims))
    return store.point_in_time_features(events, stores)


@query("point_in_time_features_bucketed", _POINT_IN_TIME)
def point_in_time_features_bucketed(spark, folder):
    """The same from saved tables, whose rows are looked up where they lie."""
    claims = checkpointed(inputs.claims_long(spark, folder))
    events = checkpointed(_events(spark, folder, claims))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stores = {}
    for kk in ("vin", "dln"):
        table = f"claim_store_{kk}_{uuid.uuid4().hex}"
        rows = store.claim_store(claims, kk, t.CALENDAR)
        store.save_claim_table(rows, kk, table, scratch_folder(claims), buckets)
        stores[kk] = read_table(spark, table)
    return store.point_in_time_features(events, stores, buckets=buckets)


def _term_figures(kk: str) -> str:
    x, y = [k for k in ("vin", "dln", "policy_num") if k != kk]
    figures = [
        f"CAST(sum(prem) AS BIGINT) / 100.0 AS term_prem_{kk}",
        f"(CAST(sum(prem) AS BIGINT) / 100.0) / nullif(sum(ver_days), 0) AS term_prem_mean_{kk}",
        f"count(DISTINCT ver_eff) AS ver_cnt_{kk}",
        f"min(ver_days) AS ver_days_min_{kk}", f"max(ver_days) AS ver_days_max_{kk}",
        f"avg(term_days) AS term_days_mean_{kk}",
        f"count(DISTINCT {x}) AS cntd_{x}_{kk}", f"count(DISTINCT {y}) AS cntd_{y}_{kk}",
    ]
    for c in history.HISTORY_COVERAGES:
        figures += [
            f"(CAST(sum({c}) AS BIGINT) / 100.0) / nullif(sum(ver_days), 0) AS term_loss_mean_{c}_{kk}",
            f"CAST(sum({c}) AS BIGINT) / 100.0 AS term_loss_{c}_{kk}",
        ]
    return f"SELECT {kk}, term_eff, {', '.join(figures)} FROM session_loss GROUP BY {kk}, term_eff"


@query("term_aggregates", sql("SELECT * REPLACE (CAST(term_eff AS VARCHAR) AS term_eff) FROM terms_vin",
                              terms_vin=_term_figures("vin")))
def term_aggregates(spark, folder):
    return history.term_aggregates(inputs.session_losses(spark, folder), "vin")


def _feature_list(kk: str) -> list[str]:
    import re

    return re.findall(r"AS (\w+)(?:,| FROM session_loss)", _term_figures(kk))


def _previous(kk: str) -> tuple[str, str]:
    names = _feature_list(kk)
    ranked = f"""SELECT e.{kk}, e.term_eff, t.* EXCLUDE ({kk}, term_eff),
      date_diff('day', t.term_eff, e.term_eff) AS term_dayssince_{kk},
      row_number() OVER (PARTITION BY e.{kk}, e.term_eff ORDER BY t.term_eff DESC) AS rn
    FROM (SELECT DISTINCT {kk}, term_eff FROM sessions) e JOIN terms_{kk} t
      ON t.{kk} = e.{kk} AND t.term_eff < e.term_eff"""
    picked = ", ".join(
        f"max({n}) FILTER (rn = {r}) AS {n}_{r}"
        for r in (1, 2, 3, 4) for n in [*names, f"term_dayssince_{kk}"]
    )
    return ranked, f"SELECT {kk}, term_eff, {picked} FROM ranked_{kk} GROUP BY {kk}, term_eff"


_EXTRA = {}
for _kk in ("vin", "dln", "policy_num"):
    _EXTRA[f"terms_{_kk}"] = _term_figures(_kk)
    _EXTRA[f"ranked_{_kk}"], _EXTRA[f"previous_{_kk}"] = _previous(_kk)


@query("previous_terms", sql("""
SELECT s.policy_num, s.vin, s.dln, CAST(s.ver_eff AS VARCHAR) AS ver_eff, CAST(s.term_eff AS VARCHAR) AS term_eff,
  v.* EXCLUDE (vin, term_eff), d.* EXCLUDE (dln, term_eff), p.* EXCLUDE (policy_num, term_eff)
FROM sessions s LEFT JOIN previous_vin v ON v.vin = s.vin AND v.term_eff = s.term_eff
LEFT JOIN previous_dln d ON d.dln = s.dln AND d.term_eff = s.term_eff
LEFT JOIN previous_policy_num p ON p.policy_num = s.policy_num AND p.term_eff = s.term_eff""", **_EXTRA))
def previous_terms(spark, folder):
    claims = stored(inputs.claims_long(spark, folder))  # their shuffles go before the next begin
    sessions = checkpointed(inputs.session_losses(spark, folder, claims))
    rows = sessions.select("policy_num", "vin", "dln", "ver_eff", "term_eff")
    return history.add_previous_terms(rows, sessions)
