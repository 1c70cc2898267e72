import math
import random
import statistics

from pyspark.sql import functions as F

from hindcast.operators import checks, ordering, profiles

SCHEMA = "day string, id string, amount double"


def table(spark, days=3, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [
        (f"d{d}", f"i{rng.randrange(700)}" if rng.random() > 0.1 else None,
         round(rng.gauss(100, 30), 2) if rng.random() > 0.2 else None)
        for d in range(days) for _ in range(n if d else 3 * n)  # the first day is a hot one
    ]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_merged_partitions_equal_one_pass_and_are_within_the_error(spark):
    rows, df = table(spark)
    sketches = profiles.column_sketches(df, ["id", "amount"], ["day"])
    assert sketches.count() == 3 * 2
    merged = {r["column_name"]: r for r in profiles.merged_profile(sketches).collect()}
    ids = {r[1] for r in rows}
    values = sorted(r[2] for r in rows if r[2] is not None)
    found = merged["id"]
    assert found["rows"] == len(rows) and found["quantiles"] is None and found["mean"] is None
    assert found["null_ratio"] == round(sum(r[1] is None for r in rows) / len(rows), 4)
    assert abs(found["distinct_values"] - len(ids)) <= 4 * profiles.DISTINCT_ERROR * len(ids)
    found = merged["amount"]
    assert (found["smallest"], found["largest"]) == (values[0], values[-1])
    assert math.isclose(found["mean"], sum(values) / len(values))
    for q, estimate in zip(profiles.QUARTILES, found["quantiles"]):
        below = sum(v < estimate for v in values) / len(values)
        up_to = sum(v <= estimate for v in values) / len(values)
        slack = 2 * profiles.RANK_ERROR
        assert below - slack <= q <= up_to + slack


def test_profiles_by_group_of_partitions(spark):
    _, df = table(spark)
    sketches = profiles.column_sketches(df, ["amount"], ["day"])
    daily = profiles.merged_profile(sketches, group=["day"]).collect()
    assert sorted(r["day"] for r in daily) == ["d0", "d1", "d2"]
    assert sum(r["rows"] for r in daily) == df.count()


def test_columns_without_values_and_empty_tables(spark):
    df = spark.createDataFrame([("d", None, None), ("d", None, float("nan"))], SCHEMA)
    merged = {r["column_name"]: r for r in profiles.merged_profile(
        profiles.column_sketches(df, ["id", "amount"], ["day"])).collect()}
    assert merged["id"]["distinct_values"] == 1 and merged["id"]["null_ratio"] == 1.0
    assert merged["amount"]["quantiles"] is None and merged["amount"]["null_ratio"] == 0.5
    empty = df.limit(0)
    assert profiles.column_sketches(empty, ["id"], ["day"]).count() == 0
    whole = profiles.merged_profile(profiles.column_sketches(empty, ["id"])).collect()
    assert [(r["rows"], r["null_ratio"], r["distinct_values"]) for r in whole] == [(0, None, 0)]


def test_exact_summary_against_plain_statistics(spark):
    rows, df = table(spark, days=1, n=300)
    values = sorted(r[2] for r in rows if r[2] is not None)
    got = profiles.exact_summary(df.withColumn("none", F.lit(None).cast("double")),
                                 ["amount", "none"]).collect()
    assert [r["column_name"] for r in got] == ["amount"]
    r = got[0]
    want = statistics.quantiles(values, n=4, method="inclusive")
    assert r["count"] == len(values) and (r["min"], r["max"]) == (values[0], values[-1])
    assert math.isclose(r["mean"], statistics.fmean(values))
    assert math.isclose(r["stddev"], statistics.stdev(values))
    assert all(math.isclose(a, b) for a, b in zip((r["q25"], r["q50"], r["q75"]), want))


def test_several_quantiles_in_one_pass_equal_single_ones(spark):
    _, df = table(spark, days=1, n=200)
    cells = ordering.cells_of(df, ["amount"])
    several = {r["q"]: r["quantile"] for r in ordering.quantile_table(cells, [0.1, 0.95]).collect()}
    for q, value in several.items():
        assert ordering.exact_quantiles(cells, q).first()["quantile"] == value


def test_watched_tables_are_evaluated_once_and_counted(spark):
    evaluated = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            evaluated.add(batch.num_rows)
            yield batch

    rows, df = table(spark, days=2, n=50)
    written, seen = checks.watched(
        df.mapInArrow(count, SCHEMA), ["id"], high=F.col("amount") > 100)
    assert written.count() == len(rows) and evaluated.value == len(rows)
    assert seen == {
        "rows": len(rows), "null_id": sum(r[1] is None for r in rows),
        "high": sum(r[2] is not None and r[2] > 100 for r in rows),
    }
    assert checks.watched(df.limit(0), ["id"])[1] == {"rows": 0, "null_id": 0}
    verdict = checks.from_figures(spark, "all", seen["rows"], len(rows), True).collect()
    assert [tuple(r) for r in verdict] == [("all", len(rows), len(rows), True)]
