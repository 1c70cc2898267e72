"""Sources and sinks: tables written in each format next to the checkpoints, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast import sources
from hindcast.operators.reliable import scratch_folder
from workloads import tables as t
from workloads.registry import query


@query("source_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_table(spark, folder):
    t.table(spark, folder, "nation").createOrReplaceTempView("hindcast_nation")
    return sources.read_table(spark, "hindcast_nation")


@query("source_delimited", """
SELECT n_nationkey AS province_dim_id, 'CA' AS country_code, n_name AS province,
  CAST(n_nationkey + 10 AS VARCHAR) AS prov_code, 'P' || n_nationkey AS prov_abbrev,
  CASE WHEN n_regionkey = 0 THEN NULL ELSE 'R' || n_regionkey END AS region, NULL AS alternate_region
FROM nation""")
def source_delimited(spark, folder):
    """Without a header, ``|`` between the columns, empty fields as NULL."""
    rows = t.table(spark, folder, "nation").selectExpr(
        "n_nationkey", "'CA'", "n_name", "cast(n_nationkey + 10 as string)",
        "concat('P', n_nationkey)",
        "case when n_regionkey = 0 then null else concat('R', n_regionkey) end",
        "cast(null as string)",
    ).toDF(*sources.province_dim_schema().names)
    path = scratch_folder(rows)
    rows.write.csv(path, sep="|")
    return sources.read_delimited(spark, path, sources.province_dim_schema(), sep="|")


@query("source_delimited_header", """
SELECT 'AUTO' AS line_of_business, p_size AS line_type, p_name AS line_type_desc,
  'T' || p_partkey AS cvg_type_cd, p_brand AS modeling_id_cl FROM part""")
def source_delimited_header(spark, folder):
    rows = t.table(spark, folder, "part").selectExpr(
        "'AUTO'", "p_size", "p_name", "concat('T', p_partkey)", "p_brand",
    ).toDF(*sources.coverage_map_schema().names)
    path = scratch_folder(rows)
    rows.write.csv(path, header=True)
    return sources.read_delimited(spark, path, sources.coverage_map_schema(), header=True)


@query("source_strings", """
SELECT c_name AS policy_number, c_mktsegment AS segment,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS xgb_lc_coll
FROM customer""")
def source_strings(spark, folder):
    """All text with a header, columns by name; what is no number becomes NULL."""
    rows = t.table(spark, folder, "customer").selectExpr(
        "c_mktsegment as segment",
        "case when c_custkey % 7 = 0 then 'n/a' else cast(c_nationkey as string) end as xgb_lc_coll",
        "c_name as policy_number",
    )
    path = scratch_folder(rows)
    rows.write.csv(path, header=True)
    return sources.read_strings(
        spark, path, ["policy_number", "segment", "xgb_lc_coll"], ["xgb_lc_coll"])


def _clicks(row: str) -> str:
    numbers = ", ".join(f"CAST(CAST((user_id + {i}) % 97 AS FLOAT) AS {row}) AS I{i}"
                        for i in range(1, 14))
    words = ", ".join(f"CASE WHEN (event_id + {i}) % 5 = 0 THEN NULL ELSE event_type END AS C{i}"
                      for i in range(1, 27))
    return f"CAST(event_id % 2 AS INT) AS label, {numbers}, {words}"


@query("source_click_log", f"SELECT {_clicks('DOUBLE')} FROM events")
def source_click_log(spark, folder):
    """40 columns between tabs, many of them empty."""
    t.table(spark, folder, "events").createOrReplaceTempView("hindcast_events")
    rows = spark.sql(f"SELECT {_clicks('FLOAT')} FROM hindcast_events")
    path = scratch_folder(rows)
    rows.write.csv(path, sep="\t")
    return sources.read_delimited(spark, path, sources.click_log_schema(), sep="\t")


@query("source_csv_parts", """
SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders""")
def source_csv_parts(spark, folder):
    """Parts in several folders, found by a pattern."""
    rows = t.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    path = scratch_folder(rows)
    rows.write.partitionBy("o_orderstatus").csv(path, header=True)
    found = sources.read_csv_parts(
        spark, f"{path}/*/*.csv", "o_orderkey bigint, o_custkey bigint")
    status = F.regexp_extract(F.input_file_name(), "o_orderstatus=([^/]+)/", 1)
    return found.withColumn("o_orderstatus", status)


@query("sink_partitions", """
SELECT o_orderstatus, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys,
  CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS run FROM orders GROUP BY o_orderstatus""")
def sink_partitions(spark, folder):
    """A second run writes one status again and leaves the others as they were."""
    rows = t.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    path = sources.store_path(scratch_folder(rows), "orders")
    sources.overwrite_partitions(rows.withColumn("run", F.lit(1)), path, ["o_orderstatus"])
    again = rows.filter("o_orderstatus = 'F'").withColumn("run", F.lit(2))
    sources.overwrite_partitions(again, path, ["o_orderstatus"])
    return sources.read_parquet(spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"), F.max("run").alias("run"))
