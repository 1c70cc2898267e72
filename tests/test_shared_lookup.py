"""Histories of one key share a time line; largest rows are sorted by a hash of their key."""

from __future__ import annotations

import random
import re

from hindcast.operators.latest import latest_per_key
from hindcast.plans import events
from tests.helpers import day, random_day, rows


def _tables(spark):
    rng = random.Random(3)
    keys = ["a", "b", None]
    asked = [(rng.choice(keys), rng.choice(["x", "y"]), random_day(rng, days=30)) for _ in range(60)]
    asked += [("a", "x", None), ("c", None, day("2020-01-20"))]
    found = {
        name: [(rng.choice(keys), random_day(rng, days=30), rng.randrange(3)) for _ in range(40)]
        for name in ("one", "two", "three")}
    table = spark.createDataFrame(asked, "k string, d string, ver_eff date")
    histories = [
        (spark.createDataFrame(found[name], f"{key} string, at date, {name} int"), key, "at", ())
        for name, key in (("one", "k"), ("two", "d"), ("three", "k"))]
    return asked, found, table, histories


def test_shared_line_gives_each_history_its_own_newest_row(spark):
    asked, found, table, histories = _tables(spark)

    def newest(name, key, date):
        known = [] if key is None or date is None else [
            (at, v) for k, at, v in found[name] if k == key and at < date]
        return max(known)[1] if known else None

    expected = [(k, d, at, newest("one", k, at), newest("two", d, at), newest("three", k, at))
                for k, d, at in asked]
    out = events.attach_histories(table, histories)
    assert out.columns == ["k", "d", "ver_eff", "one", "two", "three"]
    assert rows(out) == sorted(expected, key=repr)


def test_histories_of_one_key_cost_one_window_and_one_join(spark):
    _, _, table, histories = _tables(spark)
    plan = events.attach_histories(table, histories)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 2
    assert len(re.findall(r"\bJoin LeftOuter", plan)) == 2


def test_assembled_events_are_stored_by_column(spark):
    _, _, table, histories = _tables(spark)
    table = table.withColumnsRenamed({"d": "policy_num"})
    regions = spark.createDataFrame([("x", "ON")], "policy_num string, prov_cd string")
    out = events.assemble(table, [h for h in histories if h[1] == "k"], regions)
    assert any("scratch-" in f for f in out.inputFiles())


def test_sort_of_a_largest_row_begins_with_a_number(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, t int, v string")
    out = latest_per_key(df, ["k"], ["t"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[(_hash|_groupingexpression)#\d+L ASC", plan), plan
    assert out.columns == ["k", "t", "v"] and rows(out) == [("a", 2, "y"), (None, 3, "z")]
