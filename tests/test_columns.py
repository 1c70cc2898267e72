import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hindcast.functions import dates, labels, rows as rowfn, savings, text
from hindcast.operators import checks, cleaning, latest, reshape
from hindcast.plans import backtest, cession, exposure
from tests.helpers import day, rows


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_noise_filter_drops_null_and_listed_ids_only(spark):
    df = spark.createDataFrame([(None,), ("",), ("UNKNOWN",), ("unknown",), ("D1",)], "dln string")
    kept = cleaning.drop_noise_ids(df, {"dln": cleaning.DRIVER_NOISE_IDS})
    assert rows(kept) == [("D1",), ("unknown",)]


def test_row_sums_with_and_without_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    got = df.select(rowfn.row_sum(["a", "b"], True), rowfn.row_sum(["a", "b"], False)).collect()
    assert [tuple(r) for r in got] == [(1, None), (3, 3)]
    assert df.agg(rowfn.strict_sum("a"), rowfn.strict_sum("b")).first()[0:2] == (2, None)


def test_latest_per_key_breaks_ties_by_all_columns(spark):
    data = [("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y"), ("b", None, "z")]
    df = spark.createDataFrame(data, "k string, t int, v string")
    assert rows(latest.latest_per_key(df, ["k"], ["t"])) == [("a", 2, "y"), ("b", None, "z")]
    assert rows(latest.first_per_key(df, ["k"], ["t"])) == [("a", 1, "x"), ("b", None, "z")]


def test_prorating_equals_the_four_cases(spark):
    on, off = day("2021-02-01"), day("2021-04-30")
    spans = [("2021-02-10", "2021-03-10"), ("2021-01-01", "2021-02-10"), ("2021-04-01", "2021-09-01"),
             ("2020-01-01", "2022-01-01"), ("2021-02-01", "2021-04-30"), ("2021-04-30", "2021-04-30"),
             ("2020-12-01", "2021-02-01"), ("2021-04-30", "2021-08-01"), ("2020-01-01", "2021-01-31"),
             ("2021-05-01", "2021-06-01"), ("2021-03-03", "2021-03-03")]
    data = [(i, day(a), day(b), (day(b) - day(a)).days, Decimal("100.00")) for i, (a, b) in enumerate(spans)]
    df = spark.createDataFrame(data, "i int, ver_eff date, ver_exp date, ver_days int, session_prem decimal(18,2)")
    want = []
    for i, eff, exp, days, prem in data:
        if on <= eff and exp <= off:
            want.append((i, prem))
        elif eff < on and on <= exp <= off:
            want.append((i, prem / days * (exp - on).days))
        elif exp > off and on <= eff <= off:
            want.append((i, prem / days * (off - eff).days))
        elif eff < on and exp > off:
            want.append((i, prem / days * (off - on).days))
    got = rows(backtest.prorated_premiums(df, "2021-02-01", "2021-04-30"), "i", "prem_segmented_sub")
    assert [g[0] for g in got] == sorted((w[0] for w in want), key=repr)
    for i, part in got:
        assert float(part) == pytest.approx(float(dict(want)[i]), abs=1e-6)


def test_dates(spark):
    assert one(
        spark, dates.months_back(F.to_date(F.lit("2016-08-31")), 6),
        dates.horizon_end(F.to_date(F.lit("2022-01-31")), 1),
        dates.parse_date(F.lit("not a date")), dates.parse_date(F.lit("2020-02-03")),
    ) == [day("2016-02-29"), day("2022-02-27"), None, day("2020-02-03")]


def test_labels(spark):
    assert one(
        spark, *[labels.loss_class(F.lit(x)) for x in (0, 1, 2000, 2001, 50000, 50001)]
    ) == [0.0, 1.0, 1.0, 2.0, 3.0, 4.0]
    assert one(
        spark, labels.log_label(F.lit(9)), labels.capped_ratio_label(F.lit(25000)),
        labels.loss_premium_label(F.lit(5), F.lit(0)),
        labels.regression_target("claim", F.lit(None), F.lit(3)),
        labels.regression_target("earn", F.lit(1), F.lit(float("nan"))),
        labels.regression_target("diff", F.lit(50000), F.lit(None)),
        labels.regression_target("ratio", F.lit(3), F.lit(1)),
        labels.regression_target("ratio", F.lit(None), F.lit(1)),
        labels.class_target("claim", F.lit(2000), F.lit(0)),
        labels.class_target("diff", F.lit(5), F.lit(None)),
        labels.class_target("diff", F.lit(0), F.lit(-1)),
        labels.threshold_label(F.lit(None)),
    ) == [math.log(10), 1.0, None, 0.0, 0.0, 10000.0, 2.0, None, 1, 1, 0, 0]
    with pytest.raises(Exception, match="must be >= 0"):
        one(spark, labels.log_label(F.col("id") - 5))
    with pytest.raises(ValueError):
        labels.regression_target("other", "a", "b")


def test_model_tokens(spark):
    df = spark.createDataFrame(
        [("CIVIC LX 4DR 2DR SEDAN",), ("F150 SUPERCAB  4WD AWD",), ("4DR",), ("10WD XWD",)], "m string"
    )
    assert [tuple(r) for r in df.select(*text.model_tokens("m")).collect()] == [
        ("-", "2DR", "SEDAN", "CIVIC LX"), ("AWD", "-", "SUPERCAB", "F150"), ("-", "4DR", "-", ""),
        ("-", "-", "-", "10WD XWD"),
    ]
    assert one(spark, text.strip_quotes(F.lit("'a'b'")), text.province_group(F.lit("NS"))) == ["a'b", "ATL"]


def test_savings_round_half_to_even(spark):
    got = one(spark, savings.expected_savings(F.lit(2.5), F.lit(0.0), F.lit(1.0), F.lit(0.3), F.lit(0.0)),
              savings.cede_decision(F.lit(100)), savings.cede_decision(F.lit(101)))
    assert got == [2.0, "N", "Y"]


def test_constants_need_exactly_one_row(spark):
    table = spark.createDataFrame([("ON", "A", 1.0, 2.0, 3.0)] * 2,
                                  "Province string, Company string, cession_percent double, annual_pool_cost double, expense_allowance double")
    for province in ("ON", "QC"):
        with pytest.raises(Exception, match="exactly one row"):
            cession.ceding_constants(table, province, "A").collect()


def test_profile_and_pruning(spark):
    df = spark.createDataFrame(
        [(1, None, "c", "x"), (2, None, "c", None), (2, None, "c", "x")],
        "a int, empty string, same string, partly string",
    )
    exact = {r["column_name"]: (r["null_ratio"], r["distinct_values"]) for r in cleaning.column_profile(df).collect()}
    assert exact == {"a": (0.0, 2), "empty": (1.0, 1), "same": (0.0, 1), "partly": (0.3333, 2)}
    rough = {r["column_name"]: (r["null_ratio"], r["distinct_values"])
             for r in cleaning.column_profile(df, approximate=True).collect()}
    assert rough == exact
    assert cleaning.prune_low_information(df).columns == ["a", "partly"]


def test_exclusion_needs_a_match(spark):
    df = spark.createDataFrame([(1, 2)], "claimAmt_history_1 int, b int")
    assert cleaning.exclude_features(df, ["claimAmt_history"]).columns == ["b"]
    with pytest.raises(ValueError):
        cleaning.exclude_features(df, ["nothing"])


def test_narrow_numbers_and_timestamps(spark):
    df = spark.sql(
        "select date'2020-03-01' as ver_eff, timestamp_ntz'2020-02-01 23:00:00' as a, "
        "timestamp'2020-02-28 01:00:00' as b, cast(1.5 as decimal(5,2)) as d, 2.5d as e, 1 as f"
    )
    out = cleaning.narrow_numbers(cleaning.timestamps_to_days(df, "ver_eff"))
    assert dict(out.dtypes) == {"ver_eff": "date", "d": "float", "e": "float", "f": "int",
                                "a_dayssince": "int", "b_dayssince": "int"}
    assert rows(out, "a_dayssince", "b_dayssince") == [(29, 2)]


def test_column_choice_by_pattern(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "xgb_a int, xgb_a_raw int, fire_prem int, ab_prem int")
    assert cleaning.columns_matching(df, cession.SCORE_PATTERN, "raw") == ["xgb_a"]
    assert cleaning.columns_matching(df, cession.PREMIUM_PATTERN) == ["ab_prem"]


def test_pivot_keeps_keys_without_listed_values(spark):
    df = spark.createDataFrame([("a", "DC", 5), ("b", "XX", 7)], "k string, c string, v int")
    assert rows(reshape.pivot_sum(df, ["k"], "c", ["DC"], "v")) == [("a", 5), ("b", 0)]
    assert rows(reshape.pivot_sum(df, ["k"], "c", ["DC"], "v", fill=False)) == [("a", 5), ("b", None)]


def test_inconsistent_terms_are_dropped(spark):
    columns = "policy_num string, vin string, dln string, term_eff date, term_days int, expos_num int"
    t = day("2020-01-01")
    df = spark.createDataFrame(
        [("ok", "v", "d", t, 365, 1), ("ok", "v", "d", t, 365, None),
         ("two lengths", "v", "d", t, 365, 1), ("two lengths", "v", "d", t, 184, 1),
         ("two numbers", "v", "d", t, 365, 1), ("two numbers", "v", "d", t, 365, 2),
         ("two numbers", "v", "e", t, 365, 1), ("no number", "v", "d", t, 365, None),
         (None, "v", "d", t, 365, 1)], columns,
    )
    kept = exposure.consistent_exposures(df)
    assert rows(kept, "policy_num", "dln", "expos_num") == sorted(
        [("ok", "d", 1), ("ok", "d", None), ("two numbers", "e", 1)], key=repr
    )


def test_session_premium_of_a_zero_day_term_is_null(spark):
    df = spark.createDataFrame([(Decimal("365.00"), 0, 30), (Decimal("365.00"), 365, 30)],
                               "p decimal(18,2), t int, v int")
    got = df.select(exposure.session_premium("p", "t", "v").alias("x")).collect()
    assert [r["x"] for r in got] == [None, Decimal("30.00")]


def test_open_ended_dates_are_prorated(spark):
    columns = "p decimal(18,2), t int, v int, eff date, exp date"
    df = spark.createDataFrame(
        [(Decimal("365.00"), 365, 2_916_095, day("2016-01-01"), day("9999-12-31"))], columns)
    on, off = F.lit("2016-01-01").cast("date"), F.lit("2016-12-31").cast("date")
    row = df.select(exposure.session_premium("p", "t", "v").alias("x"),
                    dates.prorate("p", "v", "eff", "exp", on, off).alias("y")).first()
    assert row["x"] == Decimal("2916095.00") and row["y"] == Decimal("0.045686")


def test_unreadable_exposure_values_become_null(spark):
    names = ["policy_num", "vin", "dln", "term_eff", "term_days", "ver_eff", "ver_exp", "expos_num",
             "ft_prem"]
    good = ("p", "v", "d", "2020-01-01", "365", "2020-01-01", "2020-06-01", "1", "10.50")
    bad = ("p", "v", "d", "2020-13-01", "x", "", "2020-06-01", None, "ten")
    df = spark.createDataFrame([good, bad], ", ".join(f"{n} string" for n in names))
    got = {r["term_days"]: r for r in exposure.union_exposures([df]).collect()}
    assert got[365]["ft_prem"] == Decimal("10.50") and got[365]["term_eff"] == day("2020-01-01")
    assert [got[None][n] for n in names[3:6] + names[7:]] == [None] * 5
    clean = exposure.clean_exposures([df], "2019-01-01", "2021-01-01")
    assert clean.count() == 1


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "k string, v int")
    report = checks.all_checks(
        checks.unique_key(df, ["k"], "key"), checks.same_row_count(df, df, "rows"),
        checks.not_more_keys(df, df.distinct(), ["k"], "keys"), checks.no_nulls(df, ["v"], "nulls"),
    )
    assert {r["check_name"]: (r["found"], r["expected"], r["passed"]) for r in report.collect()} == {
        "key": (1, 2, False), "rows": (2, 2, True), "keys": (1, 1, True), "nulls": (1, 0, False),
    }
    assert checks.same_columns(df, df) and not checks.same_columns(df, df.drop("v"))
