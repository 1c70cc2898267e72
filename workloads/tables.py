"""Insurance-shaped inputs, derived by Spark from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.retro import MonthEnds
from hindcast.sources import read_parquet

PERIOD = ("1995-01-01", "2001-12-31")
CLAIMS_FROM = "1995-01-01"
CALENDAR = MonthEnds("1996-08-31", "2001-12-31")
AS_OF = tuple(f"2000-{m:02d}-01" for m in range(1, 9))
TRAIN_UNTIL, TEST_FROM, TEST_UNTIL = "1999-12-31", "2000-01-01", "2000-12-31"
ALL_COVERAGES = ("DC", "COMPSP", "APCOLL", "TPL", "AB", "UIN")
CAR_CLAIMS = "R"  # returned lines stand for car claims, others for other lines of business
CLAIM_TIES = ("src_order", "src_line")
DRIVER_TIES = ("seq", "years_licensed", "disc", "status")
AREA_LOADS = ("loaded_at",)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


def exposure_sources(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Two systems: finished orders stand for the old one, all others for the new one."""
    rows = table(spark, folder, "orders")
    old = F.col("o_orderstatus") == "F"
    columns = [
        "concat('P', o_custkey) as policy_num",
        "concat('V', o_custkey % 500) as vin",
        "case when o_orderkey % 97 = 0 then 'UNKNOWN' else concat('D', o_custkey % 300) end as dln",
        "cast(date_trunc('year', o_orderdate) as date) as term_eff",
        "case when o_orderkey % 53 = 0 then 184 else 365 end as term_days",
        "cast(o_orderdate as date) as ver_eff",
        "date_add(cast(o_orderdate as date), cast(o_orderkey % 336 + 30 as int)) as ver_exp",
        "case o_orderpriority when '1-URGENT' then 'secondary' when '2-HIGH' then 'iso' "
        "else 'primary' end as driver_type",
        "case when o_orderkey % 41 = 0 then 2 else 1 end as expos_num",
        "cast(o_totalprice as decimal(18,2)) as ft_prem",
        "o_orderkey as loaded_seq",
    ]
    return [rows.filter(old).selectExpr(*columns), rows.filter(~old).selectExpr(*columns)]


def claim_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Claim versions with their parties; the lines' flag is the line of business."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.selectExpr(
        "concat('P', o_custkey) as policy_num",
        "concat('V', o_custkey % 500) as vin",
        "case when l_orderkey % 23 = 0 then 'D999' else concat('D', o_custkey % 300) end as dln",
        "concat('C', o_custkey) as int_claim_num",
        "l_returnflag as line_of_business",
        "cast(l_partkey % 6 as int) as line_type",
        "concat('line ', l_partkey % 6) as line_type_desc",
        "concat('T', l_partkey % 6) as cvg_type_cd",
        "date_add(cast(date_trunc('month', l_shipdate) as date), cast(o_custkey % 28 as int)) "
        "as loss_dt",
        "date_add(cast(l_shipdate as date), cast(l_suppkey as int)) as processed_date",
        "l_orderkey as src_order",
        "l_linenumber as src_line",
        "cast(l_extendedprice - 5000 as decimal(18,2)) as incurred_amt",
    )


def coverage_map(spark: SparkSession) -> DataFrame:
    """A mapping file's rows: line and code to modelled coverage."""
    return spark.sql(
        "SELECT 'R' AS line_of_business, line_type, concat('line ', line_type) AS line_type_desc, "
        "concat('T', line_type) AS cvg_type_cd, modeling_id_cl FROM VALUES (0, 'DC'), (1, 'COMPSP'), "
        "(2, 'APCOLL'), (3, 'TPL'), (4, 'AB'), (5, 'UIN') AS m(line_type, modeling_id_cl)"
    )


def driver_history(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "concat('D', l_orderkey % 300) as dln", "cast(l_shipdate as date) as processed_date",
        "l_linenumber as seq", "l_quantity as years_licensed", "l_discount as disc",
        "l_linestatus as status",
    )


def vehicle_history(spark: SparkSession, folder: str) -> DataFrame:
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).selectExpr(
        "concat('V', l_partkey % 500) as vin", "l_shipdate as processed_date",
        "l_orderkey as job", "p_brand as make", "p_type as body_type", "p_size as weight",
        "cast(p_retailprice as decimal(18,2)) as cost_new_amt",
        "l_shipdate - make_dt_interval(p_size * 30) as date_purchased",
        "p_size > 25 as winter_tires", "l_linenumber as fixed_id",
    )


def vehicle_postal(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).selectExpr(
        "concat('V', o_custkey % 500) as vin", "concat('K', c_nationkey) as postalcode",
        "o_orderdate as job_closed_dt",
    )


def area_map(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").selectExpr(
        "concat('A', n_regionkey) as da", "concat('K', n_nationkey) as postalcode",
        "concat('prov ', n_regionkey) as province", "n_name as municipalityname",
        "cast(n_nationkey as double) as longitude", "cast(n_regionkey as double) as latitude",
    )


def area_facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").selectExpr(
        "concat('A', r_regionkey) as da", "r_name as area_name",
        "cast(r_regionkey * 1000 as int) as population", "current_timestamp() as loaded_at",
    )


_PROVINCE = (
    "case {0} % 6 when 0 then 'ON' when 1 then 'AB' when 2 then 'NB' when 3 then 'NS' "
    "when 4 then 'PE' else 'QC' end"
)


def province_dim(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").selectExpr(
        "cast(n_nationkey as string) as prov_code",
        f"{_PROVINCE.format('n_nationkey')} as prov_abbrev",
    )


def policies_old(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric province codes; overlaps with the new system in nations 10 to 14."""
    return table(spark, folder, "customer").filter("c_nationkey < 15").selectExpr(
        "concat('P', c_custkey) as policy_num", "cast(c_nationkey as string) as prov_cd"
    )


def policies_new(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").filter("c_nationkey >= 10").selectExpr(
        "concat('P', c_custkey) as policy_num", f"{_PROVINCE.format('c_nationkey')} as prov_cd"
    )


def inforce_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores as text; some are not numbers."""
    return table(spark, folder, "customer").selectExpr(
        "concat('P', c_custkey) as policy_number", "concat('V', c_custkey % 500) as veh_vin",
        "concat('D', c_custkey % 300) as drv_license_number", "'1' as exposure_number",
        "'2000-01-01' as term_eff_dt", "'2000-01-01' as ver_eff_dt",
        "cast(cast(c_acctbal as decimal(18,2)) as string) as xgb_lc_coll",
        "cast(c_custkey % 97 as string) as xgb_freqxsev_liab",
        "case when c_custkey % 211 = 7 then 'n/a' else '12.5' end as xgb_freqxsev_dc",
        "cast(c_nationkey as string) as xgb_freqxsev_ab",
        "'0.25' as xgb_freqxsev_comp",
    )


def rsp_scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "concat('P', o_custkey) as policy_number", "concat('V', o_custkey % 500) as veh_vin",
        "cast(o_orderkey % 3 as int) as exposure_number",
        "cast(date_trunc('year', o_orderdate) as date) as term_eff_dt",
        "cast(o_orderdate as date) as ver_eff_dt",
        "cast(o_totalprice as decimal(18,2)) as xgb_lc_comp",
        "case when o_orderkey % 29 = 0 then null else cast(o_orderkey % 1000 as decimal(18,2)) end "
        "as xgb_freqxsev_ab",
        "cast(o_custkey % 50 as decimal(18,2)) as xgb_freqxsev_ab_raw",
    )


def rsp_inforce(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "concat('P', o_custkey) as policy_number", "concat('V', o_custkey % 500) as vin",
        "cast(o_orderkey % 3 as int) as exposure_number",
        "cast(date_trunc('year', o_orderdate) as date) as term_eff_dt",
        "cast(o_orderdate as date) as ver_eff_dt",
        "cast(o_orderkey % 700 as decimal(18,2)) as ab_prem",
        "cast(o_custkey as decimal(18,2)) as liab_prem",
        "case when o_orderkey % 31 = 0 then null else cast(o_totalprice as decimal(18,2)) end "
        "as coll_prem",
        "cast(o_orderkey % 90 as decimal(18,2)) as fire_prem",
        "case when o_orderkey % 17 = 0 then null else o_orderstatus = 'P' end "
        "as comprehensive_cov_only",
        "case when o_orderpriority = '5-LOW' then 'Y' else 'N' end as endt_6a",
    )


def ceding_constants(spark: SparkSession) -> DataFrame:
    """A constants file's rows, one per province and company."""
    return spark.sql(
        "SELECT Province, Company, cast(percent as decimal(8,2)) AS cession_percent, "
        "cast(pool as decimal(8,2)) AS annual_pool_cost, cast(allowance as decimal(8,2)) AS "
        "expense_allowance FROM VALUES ('ON', 'A', 0.85, 100.0, 0.30), ('AB', 'A', 0.80, 90.0, 0.25), "
        "('ON', 'B', 0.90, 110.0, 0.35) AS c(Province, Company, percent, pool, allowance)"
    )


def models(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted model names with drive, doors and shape words in them."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey",
        "concat(\"'\", upper(p_name), ' ', p_size % 6, 'DR  ', "
        "case p_size % 4 when 0 then 'SEDAN ' when 1 then 'WAGON CAB ' else '' end, "
        "case when p_size % 3 = 0 then 'AWD' when p_size % 3 = 1 then '4WD LX' else 'FWD' end, "
        "\"'\") as model",
    )


def click_log(spark: SparkSession, folder: str) -> DataFrame:
    """Label, numbers and categories, some of them missing."""
    return table(spark, folder, "events").selectExpr(
        "event_id", "case when event_type = 'purchase' then 1 else 0 end as label",
        "cast(value as float) as I1", "cast(user_id % 24 as float) as I2",
        "case when event_type = 'error' then null else props end as C1",
        "concat('u', user_id) as C2", "cast(hour(ts) as string) as C3",
    )


def edge(df: DataFrame) -> DataFrame:
    """Plain result types: decimals as double, whole numbers as bigint, dates as text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            out.append(f"cast(`{f.name}` as double) as `{f.name}`")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(f"cast(`{f.name}` as bigint) as `{f.name}`")
        elif isinstance(f.dataType, T.DateType):
            out.append(f"cast(`{f.name}` as string) as `{f.name}`")
        else:
            out.append(f"`{f.name}`")
    return df.selectExpr(*out)
