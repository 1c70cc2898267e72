"""Shared parts of the checking SQL. Money is whole cents there, so sums are exact."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["exposure_raw"] = """
SELECT 'P'||o_custkey AS policy_num, 'V'||(o_custkey % 500) AS vin,
  CASE WHEN o_orderkey % 97 = 0 THEN 'UNKNOWN' ELSE 'D'||(o_custkey % 300) END AS dln,
  CAST(date_trunc('year', o_orderdate) AS DATE) AS term_eff,
  CASE WHEN o_orderkey % 53 = 0 THEN 184 ELSE 365 END AS term_days,
  CAST(o_orderdate AS DATE) AS ver_eff,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 336 + 30 AS INTEGER) AS DATE) AS ver_exp,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'secondary' WHEN '2-HIGH' THEN 'iso'
    ELSE 'primary' END AS driver_type,
  CASE WHEN o_orderkey % 41 = 0 THEN 2 ELSE 1 END AS expos_num,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS prem_cents, o_orderkey AS loaded_seq
FROM orders"""

CTES["exposure_clean"] = """
SELECT DISTINCT *, date_diff('day', ver_eff, ver_exp) AS ver_days FROM exposure_raw
WHERE term_eff BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND prem_cents >= 0
  AND vin NOT IN ('', '1234567', '12345678', 'SEARCH', '123456', 'NF')
  AND dln NOT IN ('COMPANY','UNLICENSED','COMPAGNIE','FLEET','$$UNLICENSED','$$COMPANY','1234567',
    '','UNKNOWN','Unknown_DLN')"""

CTES["exposure_consistent"] = """
SELECT e.* FROM exposure_clean e
JOIN (SELECT policy_num, vin, term_eff FROM exposure_clean GROUP BY ALL
      HAVING count(DISTINCT term_days) = 1) a USING (policy_num, vin, term_eff)
JOIN (SELECT vin, dln, policy_num, term_eff, term_days FROM exposure_clean GROUP BY ALL
      HAVING count(DISTINCT expos_num) = 1) b USING (vin, dln, policy_num, term_eff, term_days)"""

CTES["session_premiums"] = """
SELECT policy_num, vin, dln, term_eff, term_days, ver_eff, ver_exp, ver_days, driver_type, loaded_seq,
  CAST((2 * sum(prem_cents) * ver_days + term_days) // (2 * term_days) AS BIGINT) AS prem
FROM exposure_consistent
GROUP BY policy_num, vin, dln, term_eff, term_days, ver_eff, ver_exp, ver_days, driver_type, loaded_seq"""

CTES["sessions_latest"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY vin, policy_num, ver_eff
  ORDER BY loaded_seq DESC, dln DESC) AS rn FROM session_premiums) WHERE rn = 1"""

CTES["sessions"] = """
SELECT policy_num, vin, dln, term_eff, term_days, ver_eff, ver_exp, ver_days,
  CASE WHEN driver_type = 'secondary' THEN 0 ELSE prem END AS prem
FROM sessions_latest"""

CTES["claim_rows"] = """
SELECT 'P'||o_custkey AS policy_num, 'V'||(o_custkey % 500) AS vin,
  CASE WHEN l_orderkey % 23 = 0 THEN 'D999' ELSE 'D'||(o_custkey % 300) END AS dln,
  'C'||o_custkey AS int_claim_num, 'T'||(l_partkey % 6) AS cvg_type_cd,
  CAST(CAST(date_trunc('month', l_shipdate) AS DATE) + CAST(o_custkey % 28 AS INTEGER) AS DATE)
    AS loss_dt,
  CASE l_partkey % 6 WHEN 0 THEN 'DC' WHEN 1 THEN 'COMPSP' WHEN 2 THEN 'APCOLL' WHEN 3 THEN 'TPL'
    WHEN 4 THEN 'AB' ELSE 'UIN' END AS cvg,
  CAST(CAST(l_shipdate AS DATE) + CAST(l_suppkey AS INTEGER) AS DATE) AS processed_date,
  l_orderkey AS src_order, l_linenumber AS src_line,
  CAST(CAST(l_extendedprice - 5000 AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""

CTES["claim_latest"] = """
SELECT policy_num, int_claim_num, loss_dt, cvg, cvg_type_cd, cents, processed_date FROM (
  SELECT *, row_number() OVER (PARTITION BY policy_num, int_claim_num, cvg_type_cd, loss_dt
    ORDER BY processed_date DESC, src_order DESC, src_line DESC, cents DESC) AS rn
  FROM claim_rows WHERE cents > 0 AND loss_dt >= DATE '1995-01-01') WHERE rn = 1"""

CTES["claims_long"] = """
SELECT l.*, p.dln, p.vin FROM (SELECT policy_num, int_claim_num, loss_dt, cvg,
    CAST(sum(cents) AS BIGINT) AS loss FROM claim_latest GROUP BY ALL) l
JOIN (SELECT DISTINCT policy_num, int_claim_num, loss_dt, dln, vin FROM claim_rows
      WHERE loss_dt >= DATE '1995-01-01') p
USING (policy_num, int_claim_num, loss_dt)"""

CTES["claims_wide"] = """
SELECT policy_num, vin, dln, loss_dt,
  CAST(coalesce(sum(loss) FILTER (cvg = 'DC'), 0) AS BIGINT) AS DC,
  CAST(coalesce(sum(loss) FILTER (cvg = 'COMPSP'), 0) AS BIGINT) AS COMPSP,
  CAST(coalesce(sum(loss) FILTER (cvg = 'APCOLL'), 0) AS BIGINT) AS APCOLL,
  CAST(coalesce(sum(loss) FILTER (cvg = 'TPL'), 0) AS BIGINT) AS TPL,
  CAST(coalesce(sum(loss) FILTER (cvg = 'AB'), 0) AS BIGINT) AS AB
FROM claims_long WHERE cvg <> 'UIN' GROUP BY policy_num, vin, dln, loss_dt"""

CTES["free_sessions"] = """
SELECT s.* FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM claims_wide c
  WHERE c.policy_num = s.policy_num AND c.vin = s.vin AND c.dln = s.dln
    AND c.loss_dt BETWEEN s.ver_eff AND s.ver_exp)"""

CTES["events_labelled"] = """
SELECT policy_num, vin, dln, loss_dt AS ver_eff, DC, COMPSP, APCOLL, TPL, AB FROM claims_wide
UNION ALL SELECT policy_num, vin, dln, ver_eff, 0, 0, 0, 0, 0 FROM free_sessions"""

CTES["session_loss"] = """
SELECT s.policy_num, s.vin, s.dln, s.term_eff, s.term_days, s.ver_eff, s.ver_exp, s.ver_days, s.prem,
  CAST(coalesce(sum(c.loss), 0) AS BIGINT) AS loss,
  CAST(coalesce(sum(c.loss) FILTER (cvg = 'DC'), 0) AS BIGINT) AS DC,
  CAST(coalesce(sum(c.loss) FILTER (cvg = 'COMPSP'), 0) AS BIGINT) AS COMPSP,
  CAST(coalesce(sum(c.loss) FILTER (cvg = 'APCOLL'), 0) AS BIGINT) AS APCOLL,
  CAST(coalesce(sum(c.loss) FILTER (cvg = 'TPL'), 0) AS BIGINT) AS TPL,
  CAST(coalesce(sum(c.loss) FILTER (cvg = 'UIN'), 0) AS BIGINT) AS UIN,
  CAST(coalesce(sum(c.loss) FILTER (cvg = 'AB'), 0) AS BIGINT) AS AB
FROM sessions s LEFT JOIN claims_long c ON c.policy_num = s.policy_num AND c.vin = s.vin
  AND c.dln = s.dln AND c.loss_dt BETWEEN s.ver_eff AND s.ver_exp
GROUP BY ALL"""

CTES["driver_hist"] = """
SELECT 'D'||(l_orderkey % 300) AS dln, CAST(l_shipdate AS DATE) AS processed_date,
  l_linenumber AS seq, l_quantity AS years_licensed, l_discount AS disc, l_linestatus AS status
FROM lineitem"""

CTES["vehicle_hist"] = """
SELECT 'V'||(l_partkey % 500) AS vin, l_shipdate AS processed_date, l_orderkey AS job,
  p_brand AS make, p_type AS body_type, p_size AS weight,
  CAST(p_retailprice AS DECIMAL(18,2)) AS cost_new_amt,
  CAST(l_shipdate AS DATE) - p_size * 30 AS purchased, p_size > 25 AS winter_tires
FROM lineitem JOIN part ON l_partkey = p_partkey"""

CTES["postal_hist"] = """
SELECT DISTINCT 'V'||(o_custkey % 500) AS vin, 'K'||c_nationkey AS postalcode,
  o_orderdate AS job_closed_dt, 'prov '||n_regionkey AS province, n_name AS municipalityname,
  CAST(n_nationkey AS DOUBLE) AS longitude, CAST(n_regionkey AS DOUBLE) AS latitude,
  r_name AS area_name, CAST(r_regionkey * 1000 AS BIGINT) AS population
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey"""

CTES["regions"] = """
SELECT policy_num, prov_cd, CASE WHEN prov_cd IN ('NB','NS','PE') THEN 'ATL' ELSE prov_cd END
    AS policy_province FROM (
  SELECT *, row_number() OVER (PARTITION BY policy_num ORDER BY src DESC, prov_cd DESC) AS rn FROM (
    SELECT 'P'||c_custkey AS policy_num, CASE c_nationkey % 6 WHEN 0 THEN 'ON' WHEN 1 THEN 'AB'
        WHEN 2 THEN 'NB' WHEN 3 THEN 'NS' WHEN 4 THEN 'PE' ELSE 'QC' END AS prov_cd,
      CASE WHEN c_nationkey >= 10 THEN 1 ELSE 0 END AS src
    FROM customer)) WHERE rn = 1"""

CTES["inforce"] = """
SELECT DISTINCT 'P'||c_custkey AS policy_num, 'V'||(c_custkey % 500) AS vin,
  'D'||(c_custkey % 300) AS dln,
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) + CAST(c_custkey % 97 AS DOUBLE)
    + TRY_CAST(CASE WHEN c_custkey % 211 = 7 THEN 'n/a' ELSE '12.5' END AS DOUBLE)
    + CAST(c_nationkey AS DOUBLE) + 0.25 AS mpa_score
FROM customer"""

CTES["as_of_dates"] = """
SELECT CAST(d AS DATE) AS as_of FROM generate_series(DATE '2000-01-01', DATE '2000-08-01',
  INTERVAL 1 MONTH) t(d)"""

CTES["horizons"] = """
SELECT as_of, h, CAST(as_of + to_months(h) - INTERVAL 1 DAY AS DATE) AS off_dt
FROM as_of_dates, (SELECT unnest([1, 3, 6]) AS h)"""

CTES["prem_parts"] = """
SELECT s.policy_num, s.vin, s.dln, s.ver_eff, w.as_of, w.h,
  CASE WHEN s.ver_eff >= w.as_of AND s.ver_exp <= w.off_dt THEN s.prem::HUGEINT * 10000
    ELSE (2 * s.prem::HUGEINT * 10000 * date_diff('day', greatest(s.ver_eff, w.as_of),
      least(s.ver_exp, w.off_dt)) + s.ver_days) // (2 * s.ver_days) END AS micros
FROM sessions s JOIN horizons w ON s.ver_eff <= w.off_dt AND s.ver_exp >= w.as_of"""

CTES["bt_prem"] = """
SELECT policy_num, vin, dln, as_of,
  sum(micros) FILTER (h = 1) AS p1, sum(micros) FILTER (h = 3) AS p3, sum(micros) FILTER (h = 6) AS p6
FROM prem_parts GROUP BY ALL
HAVING count(*) FILTER (h = 1) > 0 AND count(*) FILTER (h = 3) > 0 AND count(*) FILTER (h = 6) > 0"""

CTES["bt_loss"] = """
SELECT c.policy_num, c.vin, c.dln, w.as_of, w.h, sum(DC) AS DC, sum(COMPSP) AS COMPSP,
  sum(APCOLL) AS APCOLL, sum(TPL) AS TPL, sum(AB) AS AB
FROM claims_wide c JOIN horizons w ON c.loss_dt BETWEEN w.as_of AND w.off_dt GROUP BY ALL"""


def _horizon(h: int) -> str:
    return ", ".join(
        f"coalesce(l{h}.{c}, 0) / 100.0 AS {c}_loss_{h}" for c in ("DC", "COMPSP", "APCOLL", "TPL", "AB")
    )


CTES["backtest"] = f"""
SELECT i.policy_num, i.vin, i.dln, p.as_of, i.mpa_score, {_horizon(1)}, {_horizon(3)}, {_horizon(6)},
  p.p1 / 1000000.0 AS prem_1, p.p3 / 1000000.0 AS prem_3, p.p6 / 1000000.0 AS prem_6,
  {", ".join(f"CAST(coalesce(l{h}.DC + l{h}.COMPSP + l{h}.APCOLL + l{h}.TPL + l{h}.AB, 0) AS BIGINT) AS loss_{h}" for h in (1, 3, 6))},
  CAST(p.p1 AS BIGINT) AS p1, CAST(p.p3 AS BIGINT) AS p3, CAST(p.p6 AS BIGINT) AS p6
FROM inforce i JOIN bt_prem p USING (policy_num, vin, dln)
{" ".join(f"LEFT JOIN bt_loss l{h} ON l{h}.h = {h} AND l{h}.as_of = p.as_of AND l{h}.policy_num = i.policy_num AND l{h}.vin = i.vin AND l{h}.dln = i.dln" for h in (1, 3, 6))}
WHERE i.mpa_score IS NOT NULL"""


CTES["month_ends"] = """
SELECT CAST(last_day(CAST(d AS DATE)) AS DATE) AS dt
FROM generate_series(DATE '1996-08-01', DATE '2001-12-01', INTERVAL 1 MONTH) t(d)"""

CTES["retro_windows"] = """
SELECT dt, m, CAST(dt - to_months(m + 1) AS DATE) AS lo, CAST(dt - to_months(m) AS DATE) AS hi
FROM month_ends, (SELECT CAST(unnest(range(25)) AS INTEGER) AS m)"""


def store_ctes(kk: str) -> None:
    CTES[f"daily_{kk}"] = f"""
SELECT {kk}, cvg, loss_dt, sum(loss) AS loss FROM (
  SELECT DISTINCT {kk}, cvg, int_claim_num, loss_dt, loss FROM claims_long WHERE cvg <> 'UIN')
GROUP BY ALL"""
    CTES[f"retro_{kk}"] = f"""
SELECT {kk}, cvg, dt, m, CAST(sum(loss) FILTER (loss_dt < hi) // 100 AS BIGINT) AS bin,
  CAST(sum(loss) // 100 AS BIGINT) AS acum
FROM daily_{kk} JOIN retro_windows ON loss_dt >= lo AND loss_dt < dt GROUP BY ALL"""
    CTES[f"store_{kk}"] = f"""
SELECT k.{kk}, k.cvg, k.dt, list(coalesce(r.bin, 0) ORDER BY k.m) AS bins,
  list(coalesce(r.acum, 0) ORDER BY k.m) AS acum
FROM (SELECT {kk}, cvg, dt, CAST(unnest(range(25)) AS INTEGER) AS m FROM retro_{kk}
      GROUP BY {kk}, cvg, dt HAVING max(bin) > 0 OR max(acum) > 0) k
LEFT JOIN retro_{kk} r ON r.{kk} = k.{kk} AND r.cvg = k.cvg AND r.dt = k.dt AND r.m = k.m
GROUP BY ALL"""


for _kk in ("vin", "dln"):
    store_ctes(_kk)


def sql(select: str, **extra: str) -> str:
    """A statement with all the shared parts its text names, in order of use."""
    parts = {**CTES, **extra}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"[a-z_][a-z_0-9]*", text):
            if name in parts and name not in order:
                body = parts.pop(name)
                visit(body)
                order.append(name)
                bodies[name] = body

    bodies: dict[str, str] = {}
    visit(select)
    head = ",\n".join(f"{n} AS ({bodies[n].strip()})" for n in order)
    return f"WITH {head}\n{select.strip()}" if order else select.strip()
