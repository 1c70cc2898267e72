"""Saved profiles, exact summaries, samples, and checks that are counted while a table is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast import sources
from hindcast.operators import checks, cleaning, profiles
from hindcast.operators.ordering import cells_of
from hindcast.operators.reliable import checkpointed, scratch_folder
from hindcast.plans import events, exposure
from workloads import inputs
from workloads import tables as t
from workloads.ctes import sql
from workloads.registry import query

_PROFILED = ("policy_num", "vin", "dln", "term_days", "driver_type", "expos_num")
_AGAIN = 1997  # the partition that is profiled twice


@query("column_profile_sketches", sql(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, "
        f"round(count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_ratio, "
        f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values, "
        f"true AS within_error FROM profiled"
        for c in _PROFILED
    ),
    profiled="""SELECT * REPLACE (CASE WHEN expos_num = 2 THEN NULL ELSE expos_num END AS expos_num)
      FROM exposure_raw""",
))
def column_profile_sketches(spark, folder):
    """One sketch per column and year of term, one year written again, all merged.

    ``distinct_values`` are exact ones; ``within_error`` says that the merged sketches are within
    four standard deviations of them.
    """
    rows = exposure.union_exposures(t.exposure_sources(spark, folder))
    rows = checkpointed(rows.select(
        F.year("term_eff").alias("term_year"), *_PROFILED[:-1],
        F.expr("nullif(expos_num, 2)").alias("expos_num")))
    path = sources.store_path(scratch_folder(rows), "profiles")
    for part in (rows, rows.filter(F.col("term_year") == _AGAIN)):
        sketches = profiles.column_sketches(part, _PROFILED, ["term_year"])
        sources.overwrite_partitions(sketches, path, ["term_year"])
    merged = profiles.merged_profile(sources.read_parquet(spark, path))
    exact = cleaning.column_profile(rows, _PROFILED).select(
        "column_name", F.col("distinct_values").alias("exact"))
    gap = F.abs(F.col("distinct_values") - F.col("exact"))
    return merged.join(exact, "column_name").select(
        "column_name", "rows", "null_ratio", F.col("exact").alias("distinct_values"),
        (gap <= 4 * profiles.DISTINCT_ERROR * F.col("exact")).alias("within_error"),
    )


@query("premium_quartiles_sketches", sql(
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS column_name, CAST({q} AS DOUBLE) AS q, true AS within_error, "
        f"min(CAST({c} AS DOUBLE)) AS smallest, max(CAST({c} AS DOUBLE)) AS largest FROM sessions"
        for name, c in (("session_prem", "prem / 100"), ("ver_days", "ver_days"))
        for q in profiles.QUARTILES
    )))
def premium_quartiles_sketches(spark, folder):
    """Merged quartiles per year; ``within_error``: their true ranks are as near as promised."""
    columns = ["session_prem", "ver_days"]
    rows = checkpointed(inputs.sessions(spark, folder).select("ver_eff", *columns))
    yearly = profiles.column_sketches(
        rows.withColumn("year", F.year("ver_eff")), columns, ["year"])
    merged = profiles.merged_profile(yearly).select(
        "column_name", "smallest", "largest",
        F.posexplode("quantiles").alias("place", "estimate"))
    shares = F.array(*[F.lit(q) for q in profiles.QUARTILES])
    asked = checkpointed(merged.withColumn("q", F.get(shares, F.col("place"))).drop("place"))
    value, estimate, slack = F.col("value"), F.col("estimate"), F.lit(2 * profiles.RANK_ERROR)
    return cells_of(rows, columns).join(asked, "column_name").groupBy(
        "column_name", "q", "smallest", "largest"
    ).agg(
        F.avg((value < estimate).cast("int")).alias("below"),
        F.avg((value <= estimate).cast("int")).alias("up_to"),
    ).select(
        "column_name", "q", "smallest", "largest",
        ((F.col("below") <= F.col("q") + slack) & (F.col("up_to") >= F.col("q") - slack))
        .alias("within_error"),
    )


@query("premium_summary", sql("\nUNION ALL ".join(
    f"SELECT '{name}' AS column_name, count(v) AS count, round(avg(v), 6) AS mean, "
    f"round(stddev_samp(v), 6) AS stddev, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q25, "
    f"round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max "
    f"FROM (SELECT CAST({c} AS DOUBLE) AS v FROM sessions)"
    for name, c in (("session_prem", "prem / 100"), ("ver_days", "ver_days")))))
def premium_summary(spark, folder):
    found = profiles.exact_summary(inputs.sessions(spark, folder), ["session_prem", "ver_days"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "q25", "q50", "q75")})


@query("narrowed_numbers", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CAST(l_extendedprice AS DOUBLE) AS FLOAT) AS price,
  CAST(CAST(CAST(l_discount AS DECIMAL(12,2)) AS DOUBLE) AS FLOAT) AS discount, l_returnflag
FROM lineitem""")
def narrowed_numbers(spark, folder):
    """Doubles and decimals become 32-bit floats, whole numbers and text stay."""
    rows = t.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "cast(l_linenumber as bigint) as l_linenumber",
        "cast(l_extendedprice as double) as price",
        "cast(l_discount as decimal(12,2)) as discount", "l_returnflag")
    return cleaning.narrow_numbers(rows)


@query("sampled_rows", """
SELECT true AS repeats, true AS all_from_table, true AS near_share, count(*) AS rows FROM lineitem""")
def sampled_rows(spark, folder):
    """A sample of a tenth, drawn twice: the same rows, all of the table, their number as expected.

    ``near_share``: within five standard deviations of the binomial.
    """
    keys = ["l_orderkey", "l_linenumber"]
    rows = t.table(spark, folder, "lineitem").select(*keys)
    sides = [
        sources.sample_rows(rows, 0.1, seed=7).withColumn("side", F.lit(side)) for side in (1, 2)
    ] + [rows.withColumn("side", F.lit(4))]
    times = [F.count(F.when(F.col("side") == s, 1)).alias(f"n{s}") for s in (1, 2, 4)]
    drawn = sides[0].unionAll(sides[1]).unionAll(sides[2]).groupBy(*keys).agg(*times)
    total = F.sum("n4")
    return drawn.agg(
        F.bool_and(F.col("n1") == F.col("n2")).alias("repeats"),
        F.bool_and(F.col("n1") <= F.col("n4")).alias("all_from_table"),
        (F.abs(F.sum("n1") - total * 0.1) <= 5 * F.sqrt(total * 0.09)).alias("near_share"),
        total.alias("rows"),
    )


@query("checks_on_the_way", sql("""
SELECT 'sessions unique' AS check_name, count(DISTINCT (vin, policy_num, ver_eff)) AS found,
  count(*) AS expected, found = expected AS passed FROM sessions
UNION ALL SELECT 'no null premium', count(*) FILTER (prem IS NULL), 0, count(*) FILTER (prem IS NULL) = 0
  FROM sessions
UNION ALL SELECT 'versions end after they start', count(*) FILTER (ver_exp < ver_eff), 0,
  count(*) FILTER (ver_exp < ver_eff) = 0 FROM sessions
UNION ALL SELECT 'fan-in keeps rows', count(*), count(*), true FROM events_labelled"""))
def checks_on_the_way(spark, folder):
    """Rows, NULLs and conditions are counted by the jobs that write; only keys are read again."""
    sessions, seen = checks.watched(
        inputs.sessions(spark, folder), ["session_prem"],
        reversed=F.col("ver_exp") < F.col("ver_eff"))
    labelled, before = checks.watched(
        events.label_events(sessions, inputs.claims_wide(spark, folder)))
    keys = labelled.select("policy_num", "vin", "dln", "ver_eff")
    _, after = checks.watched(events.attach_histories(keys, inputs.histories(spark, folder)))
    return checks.all_checks(
        checks.unique_key(sessions, ["vin", "policy_num", "ver_eff"], "sessions unique"),
        *[
            checks.from_figures(spark, name, seen[figure], 0, seen[figure] == 0)
            for name, figure in (("no null premium", "null_session_prem"),
                                 ("versions end after they start", "reversed"))
        ],
        checks.from_figures(spark, "fan-in keeps rows", after["rows"], before["rows"],
                            after["rows"] == before["rows"]),
    )
