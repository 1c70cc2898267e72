import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindcast.operators import ordering
from hindcast.operators.frequency import frequency_encode
from hindcast.plans import evaluate, splits
from tests.helpers import rows


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([0.0, 0.0, 0.0, round(rng.random() * 50, 1)]), rng.random() if i % 17 else None)
            for i in range(3000)]
    return data, spark.createDataFrame(data, "id int, x double, y double").repartition(6)


def test_row_numbers_are_the_order(scored):
    data, df = scored
    numbered = ordering.global_row_number(df, [F.col("x").desc(), "id"], "rn")
    got = {r["id"]: r["rn"] for r in numbered.collect()}
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}


def test_quantiles_equal_numpy(scored):
    data, df = scored
    for q in (0.0, 0.5, 0.95, 0.999, 1.0):
        got = ordering.exact_quantile(df, "y", q).first()["quantile"]
        assert got == pytest.approx(np.quantile([r[2] for r in data if r[2] is not None], q))


def test_ranks_and_correlations_equal_pandas(scored):
    data, df = scored
    pdf = pd.DataFrame(data, columns=["id", "x", "y"])
    ranks = ordering.value_ranks(ordering.cells_of(df, ["x", "y"])).toPandas()
    for c in ("x", "y"):
        want = pd.DataFrame({"value": pdf[c], "rank": pdf[c].rank()}).dropna().drop_duplicates()
        got = ranks[ranks.column_name == c].set_index("value")["rank"]
        assert got.sort_index().tolist() == want.set_index("value")["rank"].sort_index().tolist()
    both = pdf.dropna()  # pairs drop their own missing values only, see the next test
    rho = ordering.rank_correlations(df, [("x", "y"), ("y", "y")]).collect()
    got = {(r["left_column"], r["right_column"]): r["rho"] for r in rho}
    want = both["x"].rank().corr(both["y"].rank())
    assert got[("x", "y")] == pytest.approx(want)
    assert got[("y", "y")] == pytest.approx(1.0)


def test_a_missing_value_counts_for_its_own_pairs_only(spark):
    data = [(1.0, 5.0, None), (2.0, 4.0, 1.0), (3.0, 1.0, None), (4.0, 2.0, 3.0), (5.0, 3.0, 2.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    pdf = pd.DataFrame(data, columns=["a", "b", "c"])
    rho = {(r[0], r[1]): r["rho"] for r in ordering.rank_correlations(
        df, [("a", "b"), ("a", "c")]).collect()}
    for pair in rho:
        known = pdf[list(pair)].dropna()
        assert rho[pair] == pytest.approx(known[pair[0]].rank().corr(known[pair[1]].rank()))


def test_correlations_by_group(spark):
    data = [(g, float(i), float((i * 7 + 3 * g) % 11)) for g in (1, 2) for i in range(11)]
    df = spark.createDataFrame(data, "g long, x double, y double")
    pdf = pd.DataFrame(data, columns=["g", "x", "y"])
    got = {r["g"]: r["rho"] for r in ordering.rank_correlations(df, [("x", "y")], ["g"]).collect()}
    for g in (1, 2):
        own = pdf[pdf.g == g]
        assert got[g] == pytest.approx(own["x"].rank().corr(own["y"].rank()))


def test_counts_come_from_training_rows(spark):
    train = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    got = frequency_encode(df.withColumn("id", F.col("k")), ["k"], train)
    assert {r["id"]: r["k_freq"] for r in got.collect()} == {"a": 2, "b": 0, None: 1}


def test_encoding_many_columns_reads_linearly(spark):
    names = [f"c{i}" for i in range(26)]
    df = spark.range(50).select(*[(F.col("id") % (i + 2)).cast("string").alias(c)
                                  for i, c in enumerate(names)])
    plan = frequency_encode(df, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("Range (") <= 2 * 26 + 2


def test_only_order_columns_are_sorted(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("s"), F.lit("wide" * 50).alias("w"))
    marked = ordering.top_fraction(df, "s", 0.3, ["id"])
    plan = marked._jdf.queryExecution().executedPlan().toString()
    rows_plan = plan[:plan.index("Subquery")]  # finding the border row is a subquery
    assert "Exchange" not in rows_plan and "Sort" not in rows_plan
    assert marked.filter("in_top").count() == 30


def test_top_fraction_of_groups_with_missing_scores(spark):
    data = [(g, None if i % 5 == 0 else float(i % 6), i) for g in ("a", "b", None) for i in range(37)]
    df = spark.createDataFrame(data, "g string, s double, i long")
    for fraction in (0.0, 0.2, 0.9, 1.0):
        got = {(r["g"], r["i"]) for r in ordering.top_fraction(
            df, "s", fraction, ["i"], group=["g"]).filter("in_top").collect()}
        want = set()
        for g in ("a", "b", None):
            own = sorted((x for x in data if x[0] == g),
                         key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
            want |= {(g, x[2]) for x in own[:int(37 * fraction)]}
        assert got == want


def test_top_fraction_cuts_inside_ties(scored):
    data, df = scored
    marked = ordering.top_fraction(df, "x", 0.5, ["id"])
    top = {r["id"] for r in marked.filter("in_top").collect()}
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    assert top == {r[0] for r in order[:1500]}


def test_lift_sides_leave_null_scores_out(spark):
    df = spark.createDataFrame(
        [(1.0, 10.0, 0.0), (2.0, 30.0, 10.0), (2.0, 10.0, 10.0), (None, 99.0, 9.0)],
        "s double, loss double, prem double",
    )
    row = evaluate.lift_at_cut(df, "s", "loss", "prem", F.lit(2.0)).first()
    assert (row["top_ratio"], row["bottom_loss"], row["bottom_ratio"]) == (2.0, 10.0, None)


def test_lookup_of_hot_and_null_keys_keeps_every_row(spark):
    data = [("hot",)] * 5000 + [(None,)] * 50 + [(f"k{i % 1500}",) for i in range(4000)]
    df = spark.createDataFrame(data, "k string").repartition(4)
    got = frequency_encode(df, ["k"]).withColumnRenamed("k_freq", "n").groupBy("n").count().collect()
    counts = pd.Series([x[0] for x in data]).fillna("null").value_counts()
    want = counts.map(counts.value_counts() * counts.value_counts().index).groupby(counts).first()
    assert {r["n"]: r["count"] for r in got} == want.to_dict()


def test_time_split_is_disjoint_exhaustive_and_ordered(spark):
    df = spark.range(1000).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("d"), "id"
    )
    out = splits.time_split(df, "d", ["id"]).groupBy("is_validation").agg(
        F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")
    ).collect()
    by = {r["is_validation"]: r for r in out}
    assert by[False]["n"] == 900 and by[True]["n"] == 100
    assert by[False]["hi"] <= by[True]["lo"]


def test_group_split_keeps_a_group_on_one_side(spark):
    df = spark.range(5000).select((F.col("id") % 400).alias("g"), "id")
    out = splits.hash_split(df, ["g"])
    sides = out.groupBy("g").agg(F.count_distinct("is_validation").alias("n"))
    assert rows(sides.select("n").distinct()) == [(1,)]
    share = out.filter("is_validation").count() / 5000
    assert 0.03 < share < 0.2
    again = splits.hash_split(df.repartition(7), ["g"])
    assert rows(out.filter("is_validation"), "id") == rows(again.filter("is_validation"), "id")
