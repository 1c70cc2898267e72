import datetime as dt
import random
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from hindcast.operators import timeline
from tests.helpers import day, money, random_day, rows

PARTY = ["policy_num", "vin", "dln"]


def test_asof_is_strict_or_inclusive_and_ties_are_ordered(spark):
    events = spark.createDataFrame(
        [("a", day("2020-05-10")), ("a", day("2020-05-01")), ("b", day("2020-05-10")),
         (None, day("2020-05-10"))],
        "k string, ver_eff date",
    )
    history = spark.createDataFrame(
        [("a", day("2020-05-01"), 1, "x"), ("a", day("2020-05-01"), 2, "y"),
         ("a", day("2020-05-10"), 9, "same day"), ("a", day("2020-05-11"), 9, "later"),
         (None, day("2020-01-01"), 9, "no key")],
        "k string, at date, seq int, v string",
    )
    strict = timeline.asof_join(events, history, ["k"], "ver_eff", "at", ["seq"])
    assert rows(strict, "k", "ver_eff", "v") == [("a", day("2020-05-10"), "y")]
    inclusive = timeline.asof_join(
        events, history, ["k"], "ver_eff", "at", ["seq"], inclusive=True, how="left"
    )
    assert rows(inclusive, "k", "ver_eff", "v") == sorted(
        [("a", day("2020-05-10"), "same day"), ("a", day("2020-05-01"), "y"),
         ("b", day("2020-05-10"), None), (None, day("2020-05-10"), None)], key=repr,
    )


def test_asof_with_timestamps_on_the_event_day(spark):
    events = spark.createDataFrame([("a", day("2020-05-10"))], "k string, ver_eff date")
    history = spark.createDataFrame(
        [("a", dt.datetime(2020, 5, 9, 23), "before"), ("a", dt.datetime(2020, 5, 10), "midnight"),
         ("a", dt.datetime(2020, 5, 10, 1), "after")],
        "k string, at timestamp, v string",
    )
    for kind in ("timestamp", "timestamp_ntz"):
        typed = history.withColumn("at", history["at"].cast(kind))
        strict = timeline.asof_join(events, typed, ["k"], "ver_eff", "at")
        assert rows(strict, "v") == [("before",)]
        inclusive = timeline.asof_join(events, typed, ["k"], "ver_eff", "at", inclusive=True)
        assert rows(inclusive, "v") == [("midnight",)]


def test_event_time_must_be_a_date(spark):
    events = spark.createDataFrame([("a", "2020-05-10")], "k string, ver_eff string")
    with pytest.raises(TypeError):
        timeline.asof_join(events, events, ["k"], "ver_eff", "ver_eff")


def _random_case(spark, seed, hot=False):
    rng = random.Random(seed)
    keys = [("P", "V", "D")] if hot else [(f"P{i % 3}", f"V{i % 2}", "D") for i in range(6)]
    sessions = []
    for i in range(80):
        start = random_day(rng)
        sessions.append((*rng.choice(keys), i, start, start + dt.timedelta(days=rng.choice([0, 1, 30, 90]))))
    claims = [(*rng.choice(keys), random_day(rng), money(rng)) for _ in range(60)]
    s = spark.createDataFrame(sessions, "policy_num string, vin string, dln string, i int, ver_eff date, ver_exp date")
    c = spark.createDataFrame(claims, "policy_num string, vin string, dln string, loss_dt date, loss decimal(18,2)")
    return sessions, claims, s, c


@pytest.mark.parametrize("hot", [False, True])
def test_interval_operators_equal_the_literal_join(spark, hot):
    sessions, claims, s, c = _random_case(spark, 5, hot)

    def hits(session):
        return [x for x in claims if x[:3] == session[:3] and session[4] <= x[3] <= session[5]]

    sums = timeline.session_sums(s, c, PARTY, "ver_eff", "ver_exp", "loss_dt", ["loss"])
    assert rows(sums, "i", "loss") == sorted(
        ((x[3], sum((h[4] for h in hits(x)), Decimal("0.00"))) for x in sessions), key=repr
    )
    free = timeline.sessions_without_event(s, c, PARTY, "ver_eff", "ver_exp", "loss_dt")
    assert rows(free, "i") == sorted(((x[3],) for x in sessions if not hits(x)), key=repr)
    both = timeline.events_and_free_sessions(
        s, c, PARTY, "ver_eff", "ver_exp", "loss_dt", ["loss"]
    )
    expected = [(*x[:4], x[4]) for x in claims]
    expected += [(*x[:3], x[4], Decimal("0.00")) for x in sessions if not hits(x)]
    assert rows(both) == sorted(expected, key=repr)
    matched = timeline.match_sessions(s, c, PARTY, "ver_eff", "ver_exp", "loss_dt", ["loss"])
    for row in matched.collect():
        session = next(x for x in sessions if x[3] == row["i"])
        days = {}
        for h in hits(session):
            days[h[3]] = days.get(h[3], 0) + h[4]
        assert [(h["loss_dt"], h["loss"]) for h in row["hits"]] == sorted(days.items())


def test_interval_edges_and_null_keys(spark):
    s = spark.createDataFrame(
        [("P", "V", "D", day("2020-01-10"), day("2020-01-20")),
         ("P", "V", "D", day("2020-01-20"), day("2020-01-30")),
         ("P", "V", "D", day("2020-02-01"), day("2020-02-05")),
         (None, "V", "D", day("2020-01-10"), day("2020-01-30"))],
        "policy_num string, vin string, dln string, ver_eff date, ver_exp date",
    )
    shared = spark.createDataFrame(
        [("P", "V", "D", day("2020-01-20"), Decimal("5.00")),
         ("P", "V", "D", day("2020-01-31"), Decimal("7.00")),
         (None, "V", "D", day("2020-01-15"), Decimal("9.00"))],
        "policy_num string, vin string, dln string, loss_dt date, loss decimal(18,2)",
    )
    sums = timeline.session_sums(s, shared, PARTY, "ver_eff", "ver_exp", "loss_dt", ["loss"])
    assert rows(sums, "policy_num", "ver_eff", "loss") == sorted(
        [("P", day("2020-01-10"), Decimal("5.00")), ("P", day("2020-01-20"), Decimal("5.00")),
         ("P", day("2020-02-01"), Decimal("0.00")), (None, day("2020-01-10"), Decimal("0.00"))],
        key=repr,
    )
    free = timeline.sessions_without_event(s, shared, PARTY, "ver_eff", "ver_exp", "loss_dt")
    assert rows(free, "policy_num", "ver_eff") == sorted(
        [("P", day("2020-02-01")), (None, day("2020-01-10"))], key=repr
    )


def test_each_value_is_looked_up_on_its_own(spark):
    points = spark.createDataFrame([("a", day("2020-03-01"))], "k string, d date")
    history = spark.createDataFrame(
        [("a", day("2020-01-31"), 1, None), ("a", day("2020-02-29"), None, 2)],
        "k string, dt date, x int, y int",
    )
    found = timeline.read_timeline(points, history, ["k"], "d", "dt", ["x", "y"])
    assert rows(found) == [("a", day("2020-03-01"), 1, 2)]


def test_open_ended_sessions_list_the_months_of_the_events_only(spark):
    s = spark.createDataFrame(
        [("a", day("2016-01-01"), day("9999-12-31")), ("b", day("2016-01-01"), day("9999-12-31")),
         ("a", day("2030-01-01"), day("9999-12-31")), ("a", day("2020-03-05"), day("2020-03-04"))],
        "k string, start date, stop date",
    )
    events = spark.createDataFrame(
        [("a", day("2020-01-31"), 1), ("a", day("2020-03-05"), 2), ("c", day("2018-07-01"), 9)],
        "k string, d date, x int",
    )
    got = {(r["k"], r["start"]): [(h["d"], h["x"]) for h in r["hits"]] for r in timeline.match_sessions(
        s, events, ["k"], "start", "stop", "d", ["x"]).collect()}
    assert got == {
        ("a", day("2016-01-01")): [(day("2020-01-31"), 1), (day("2020-03-05"), 2)],
        ("b", day("2016-01-01")): [], ("a", day("2030-01-01")): [], ("a", day("2020-03-05")): [],
    }
    none = timeline.match_sessions(s, events.filter("x > 9"), ["k"], "start", "stop", "d", ["x"])
    assert [r["hits"] for r in none.collect()] == [[]] * 4


def test_points_without_a_key_are_dealt_by_date(spark):
    points = spark.createDataFrame(
        [(None, day("2020-01-01") + dt.timedelta(days=i)) for i in range(400)] + [("a", day("2020-05-01"))],
        "k string, d date")
    history = spark.createDataFrame([("a", day("2020-01-01"), 5)], "k string, dt date, x int")
    found = timeline.read_timeline(points, history, ["k"], "d", "dt", ["x"])
    assert {r["x"] for r in found.filter("k is null").collect()} == {None}
    assert rows(found.filter("k = 'a'"), "x") == [(5,)]
    parts = found.filter("k is null").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def rows_into_windows(df):
    """Rows shuffled into each window of the executed plan."""
    df.collect()
    found = []

    def walk(node, below):
        name = node.nodeName()
        if name == "Window":
            below = True
        if name == "Exchange" and below:
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
            below = False
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan(), below)
        if "QueryStage" in name or name.endswith("Stage"):
            return walk(node.plan(), below)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), below)

    walk(df._jdf.queryExecution().executedPlan(), False)
    return found


@pytest.mark.parametrize("one_day", [False, True])
def test_a_key_with_a_third_of_all_rows_costs_its_days(spark, one_day):
    days = 1 if one_day else 40
    hot = F.col("id") % 3 == 0
    base = spark.range(30_000).select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        F.date_add(F.lit("2021-01-01").cast("date"), (F.col("id") * 7 % days).cast("int")).alias("start"),
        F.col("id"))
    sessions = base.select("k", "start", F.date_add("start", 9).alias("stop"), "id")
    events = base.select("k", F.date_add("start", 4).alias("d"),
                         (F.col("id") % 5).cast("decimal(10,2)").alias("x"))
    bound = 501 * days * 3 + 10
    sums = timeline.session_sums(sessions, events, ["k"], "start", "stop", "d", ["x"])
    free = timeline.sessions_without_event(sessions, events, ["k"], "start", "stop", "d")
    both = timeline.events_and_free_sessions(sessions, events, ["k"], "start", "stop", "d", ["x"])
    for df in (sums, free, both):
        sizes = rows_into_windows(df)
        assert sizes and max(sizes) <= min(bound, 30_000), sizes
        assert "hot" in {r["k"] for r in df.limit(30_000).collect()} or df is free
    hot_rows = sums.filter("k = 'hot' and start = '2021-01-01'")
    per_day = {r["d"]: r["x"] for r in events.filter("k = 'hot'").groupBy("d").agg(F.sum("x").alias("x")).collect()}
    want = sum((x for d, x in per_day.items() if day("2021-01-01") <= d <= day("2021-01-10")), 0)
    assert {r["x"] for r in hot_rows.collect()} == {want}
