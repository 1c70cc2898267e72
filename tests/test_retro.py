import datetime as dt
import random
import statistics
from decimal import Decimal

from hindcast.functions import maps
from hindcast.operators.retro import MonthEnds, retro_exposures, retro_losses, snapshot_grid
from hindcast.plans import history, store
from pyspark.sql import functions as F
from tests.helpers import day, money, months_before, random_day, rows

CALENDAR = MonthEnds("2020-02-29", "2021-06-30")


def month_ends():
    out, d = [], day("2020-03-01")
    while d <= day("2021-07-01"):
        out.append(d - dt.timedelta(days=1))
        d = (d + dt.timedelta(days=32)).replace(day=1)
    return out


def test_grid_and_calendar(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",)], "vin string")
    grid = snapshot_grid(ids, "vin", CALENDAR)
    assert rows(grid) == sorted([(i, d) for i in "ab" for d in month_ends()], key=repr)


def test_retro_losses_equal_the_literal_windows(spark):
    rng = random.Random(3)
    reach = 5
    edges = [day(x) for x in ("2020-02-29", "2020-03-31", "2020-12-31", "2020-08-30", "2020-01-31")]
    claims = []
    for i in range(150):
        at = rng.choice(edges) if i % 3 == 0 else random_day(rng, "2019-10-01", 700)
        claims.append((rng.choice("ab"), rng.choice(["DC", "AB", "UIN"]), f"C{i % 40}", at, money(rng, 5)))
    claims += claims[:20]
    df = spark.createDataFrame(
        claims, "vin string, cvg string, int_claim_num string, loss_dt date, loss_sum decimal(18,2)"
    )
    got = retro_losses(df, "vin", CALENDAR, ["DC", "AB"], reach)
    expected = []
    for vin in "ab":
        for cvg in ("DC", "AB"):
            mine = {c for c in claims if c[0] == vin and c[1] == cvg}
            for d in month_ends():
                def total(lo, hi):
                    return int(sum(c[4] for c in mine if lo <= c[3] < hi))
                bins = [total(months_before(d, m + 1), months_before(d, m)) for m in range(reach + 1)]
                acum = [total(months_before(d, m + 1), d) for m in range(reach + 1)]
                if any(bins) or any(acum):
                    expected.append((vin, cvg, d, bins, acum))
    assert rows(got) == sorted(expected, key=repr)


def test_retro_exposures_equal_the_literal_windows(spark):
    rng = random.Random(4)
    windows = [(0, 3), (0, 6), (3, 6)]
    sessions = []
    for i in range(120):
        start = random_day(rng, "2019-06-01", 800)
        days = rng.choice([0, 10, 31, 60, 200])
        sessions.append((rng.choice("ab"), f"D{rng.randrange(4)}", rng.choice(["P1", "P2", None]),
                         start.replace(month=1, day=1), start, start + dt.timedelta(days=days), days, money(rng)))
    df = spark.createDataFrame(
        sessions,
        "vin string, dln string, policy_num string, term_eff date, ver_eff date, ver_exp date, "
        "ver_days int, session_prem decimal(18,2)",
    )
    got = retro_exposures(df, "vin", ["dln", "policy_num"], CALENDAR, windows)
    expected = []
    for vin in "ab":
        for d in month_ends():
            for near, far in windows:
                lo, hi = months_before(d, far), months_before(d, near)
                mine = [s for s in sessions if s[0] == vin and lo <= s[4] and hi > s[5]]
                if not mine:
                    continue
                prem, days = [s[7] for s in mine], [Decimal(s[6]) for s in mine]
                n = len(mine)
                expected.append((
                    vin, d, near, far, int(sum(prem)),
                    int(statistics.variance(prem)) if n > 1 else 0, int(sum(prem) / n),
                    int(sum(days) / n), int(statistics.variance(days)) if n > 1 else 0,
                    len({s[1] for s in mine}), len({s[2] for s in mine} - {None}),
                    len({s[3] for s in mine}), len({s[4] for s in mine}),
                ))
    assert rows(got) == sorted(expected, key=repr)


def test_nested_store_and_lookup_agree_with_the_rows(spark):
    rng = random.Random(8)
    claims = spark.createDataFrame(
        [(rng.choice("ab"), "DC", f"C{i}", random_day(rng, "2019-12-01", 500), money(rng)) for i in range(20)],
        "vin string, cvg string, int_claim_num string, loss_dt date, loss_sum decimal(18,2)",
    )
    stored = store.claim_store(claims, "vin", CALENDAR, ["DC"], 2)
    events = spark.createDataFrame(
        [(v, d) for v in "abz" for d in (day("2019-01-01"), day("2020-02-29"), day("2020-10-15"))],
        "vin string, ver_eff date",
    )
    wide = store.point_in_time_features(events, {"vin": stored}, ["DC"], 2)
    names = store.loss_feature_names(["vin"], ["DC"], 2)
    nested = store.nested_claim_store(stored, "vin", "DC")
    found = events.join(nested, "vin", "left").withColumn(
        "v", maps.map_to_vector(maps.merge_maps([maps.latest_snapshot("properties", "ver_eff")]), names)
    )
    via_maps = store.features_from_vector(found.drop("properties"), "v", names)
    assert rows(wide, "vin", "ver_eff", *names) == rows(via_maps, "vin", "ver_eff", *names)


def test_a_bucketed_store_is_looked_up_where_it_lies(spark, tmp_path):
    rng = random.Random(9)
    # One id holds a third of all entries; ids, coverages and dates repeat, some ids are unknown.
    ids = ["a"] * 20 + [f"id{n}" for n in range(40)] + [None]
    stored = {(rng.choice(ids), rng.choice(["DC", "TPL", "other"]), rng.randrange(0, 400, 20)):
              (rng.randrange(1, 99), rng.randrange(1, 99)) for _ in range(1500)}
    start = day("2020-01-01")
    entries = [(i, c, start + dt.timedelta(days=d), [x, 0], [x, y])
               for (i, c, d), (x, y) in stored.items()]
    entries += entries[:50]
    events = [(n, rng.choice([*ids, "z"]), start + dt.timedelta(days=rng.randrange(-20, 420)))
              for n in range(700)] + [(700, "a", None), (701, None, start)]
    store_rows = spark.createDataFrame(
        entries, "vin string, cvg string, dt date, bins array<bigint>, acum array<bigint>")
    event_rows = spark.createDataFrame(events, "n long, vin string, ver_eff date")

    def newest(vin, when, coverage):
        dated = [(d, v) for (i, c, d), v in stored.items() if vin is not None and i == vin
                 and c == coverage and when is not None and start + dt.timedelta(days=d) <= when]
        return max(dated)[1] if dated else None

    want = []
    for n, vin, when in events:
        figures = []
        for c in ("DC", "TPL"):
            x, y = newest(vin, when, c) or (0, 0)
            figures += [x, x, 0, y]  # bin and total of the month itself, then of the one before
        want.append((n, vin, when, *figures))

    buckets = 4
    store.save_claim_table(store_rows, "vin", "bucketed_claims", str(tmp_path / "t"), buckets)
    table = spark.table("bucketed_claims")
    found = store.point_in_time_features(event_rows, {"vin": table}, ["DC", "TPL"], 1, buckets)
    assert rows(found) == sorted(want, key=repr)
    plain = store.point_in_time_features(event_rows, {"vin": store_rows}, ["DC", "TPL"], 1)
    assert rows(plain) == sorted(want, key=repr)
    none = store.point_in_time_features(event_rows, {"vin": store_rows.limit(0)}, ["DC"], 0)
    assert {r[3:] for r in rows(none)} == {(0, 0)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked_up = store._lookup_in_buckets(event_rows, table, "vin", ["DC", "TPL"], buckets)
        plan = looked_up._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_claims")
    # The two exchanges deal the dates asked for; no row of the store is dealt again.
    assert "Bucketed: true" in plan and plan.count("Exchange") == 2
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "FileScan" in line)
    assert not any("Exchange" in line for line in lines[:scan])


def test_merge_maps_last_wins_and_lookup_edges(spark):
    df = spark.createDataFrame(
        [({"a": 1, "b": 2}, {"b": 3}, None)], "x map<string,int>, y map<string,int>, z map<string,int>"
    )
    merged = df.select(maps.merge_maps(["x", "y", "z"]).alias("m")).first()["m"]
    assert merged == {"a": 1, "b": 3}
    snaps = spark.createDataFrame(
        [({"2020-01-31": {"f": 1}, "2020-02-29": {"f": 2}},)], "s map<string,map<string,int>>"
    )
    picks = snaps.select(
        *[maps.latest_snapshot("s", F.to_date(F.lit(d))) for d in ("2020-01-30", "2020-01-31", "2020-12-31")]
    ).first()
    assert list(picks) == [None, {"f": 1}, {"f": 2}]


def test_previous_terms_take_the_four_latest_earlier_starts(spark):
    years = [day(f"{y}-01-01") for y in range(2010, 2017)]
    terms = spark.createDataFrame(
        [("v", d, float(d.year)) for d in years], "vin string, term_eff date, prem double"
    )
    events = spark.createDataFrame(
        [("v", day("2015-01-01")), ("v", day("2011-06-01")), ("w", day("2015-01-01"))],
        "vin string, term_eff date",
    )
    got = history.previous_terms(events, terms, "vin").orderBy("vin", "term_eff").collect()
    assert [r["prem_1"] for r in got] == [2011.0, 2014.0, None]
    assert [r["prem_4"] for r in got] == [None, 2011.0, None]
    assert [r["term_dayssince_vin_1"] for r in got] == [151, 365, None]


def test_a_saved_store_is_read_back_per_id_kind(spark, tmp_path):
    claims = spark.createDataFrame(
        [("a", "D1", "DC", "C1", day("2020-05-05"), Decimal("12.50")),
         ("a", "D1", "AB", "C2", day("2020-06-05"), Decimal("7.00"))],
        "vin string, dln string, cvg string, int_claim_num string, loss_dt date, loss_sum decimal(18,2)",
    )
    stores = {kk: store.claim_store(claims, kk, CALENDAR, ["DC", "AB"], 1) for kk in ("vin", "dln")}
    for kk, stored in stores.items():
        store.save_claim_store(stored, kk, str(tmp_path))
    for kk, stored in stores.items():
        assert rows(store.load_claim_store(spark, kk, str(tmp_path))) == rows(stored)


def test_terms_known_before_wait_for_their_end(spark):
    terms = spark.createDataFrame(
        [("v", day("2014-01-01"), 1.0, day("2014-12-31")), ("v", day("2015-01-01"), 2.0, day("2016-03-01"))],
        "vin string, term_eff date, prem double, term_end date",
    )
    events = spark.createDataFrame([("v", day("2016-01-01"))], "vin string, term_eff date")
    assert history.previous_terms(events, terms, "vin").first()["prem_1"] == 2.0
    assert history.previous_terms(events, terms, "vin", known_before=True).first()["prem_1"] == 1.0


def test_sums_beyond_32_bits_fit_the_nested_store(spark):
    sessions = spark.createDataFrame(
        [("V", "D", f"P{i}", day("2020-03-01"), day("2020-04-01"), day("2020-03-01"), 31,
          Decimal(1_000_000_000 * (i + 1))) for i in range(4)],
        "vin string, dln string, policy_num string, ver_eff date, ver_exp date, term_eff date, "
        "ver_days int, session_prem decimal(18,2)")
    stored = store.exposure_store(sessions, "dln", CALENDAR)
    nested = store.nested_exposure_store(stored, "dln").collect()
    values = [v for inner in nested[0]["properties"].values() for v in inner.values()]
    assert max(values) > 2 ** 31


def test_rows_per_snapshot_are_not_shuffled(spark):
    claims = spark.createDataFrame(
        [(f"P{i}", "DC", f"C{i}", random_day(random.Random(i)), Decimal(i + 1)) for i in range(30)],
        "policy_num string, cvg string, int_claim_num string, loss_dt date, loss_sum decimal(18,2)")
    stored = retro_losses(claims, "policy_num", CALENDAR, ["DC"], 5)
    plan = stored._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [k for k, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert dealt and min(dealt) > max(k for k, line in enumerate(plan) if "Generate explode" in line)


def test_exposures_are_not_repeated_per_month(spark):
    start = day("2020-03-01")
    sessions = spark.createDataFrame(
        [("V1", f"D{i % 7}", f"P{i}", start, start + dt.timedelta(days=i % 90), start, i % 90, Decimal(i))
         for i in range(200)],
        "vin string, dln string, policy_num string, ver_eff date, ver_exp date, term_eff date, "
        "ver_days int, session_prem decimal(18,2)")
    stored = retro_exposures(sessions, "vin", ["dln", "policy_num"], CALENDAR)
    plan = stored._jdf.queryExecution().executedPlan().toString().splitlines()
    months = [k for k, line in enumerate(plan) if "explode(sequence(" in line]
    dealt = [k for k, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(months) == 1 and dealt and min(dealt) > months[0]


def test_a_value_counts_once_over_sessions_that_overlap_or_leave_gaps(spark):
    ends = [("2020-01-10", "2020-02-10"), ("2020-01-20", "2020-02-05"), ("2020-01-10", "2020-02-10"),
            ("2020-11-30", "2020-12-31"), ("2020-05-31", "2020-04-30")]
    sessions = spark.createDataFrame(
        [("V", "D", None, day(a), day(b), day("2020-01-01"), None, None) for a, b in ends],
        "vin string, dln string, policy_num string, ver_eff date, ver_exp date, term_eff date, "
        "ver_days int, session_prem decimal(18,2)")
    windows = [(0, 3), (3, 6), (0, 12)]
    got = {(r["dt"], r["near_months"], r["far_months"]): (r["cntdist_dln"], r["cntdist_policy_num"], r["cntdist_ver_eff"], r["prem_sum"])
           for r in retro_exposures(sessions, "vin", ["dln", "policy_num"], CALENDAR, windows).collect()}
    want = {}
    for d in month_ends():
        for near, far in windows:
            lo, hi = months_before(d, far), months_before(d, near)
            held = {a for a, b in ends if lo <= day(a) and hi > day(b)}
            if held:
                want[d, near, far] = (1, 0, len(held), 0)
    assert got == want


def test_nested_maps_are_read_once_per_id_and_month(spark):
    rng = random.Random(10)
    claims = spark.createDataFrame(
        [(rng.choice("ab"), c, f"C{i}", random_day(rng, "2019-12-01", 500), money(rng))
         for i in range(30) for c in ("DC", "AB")],
        "vin string, cvg string, int_claim_num string, loss_dt date, loss_sum decimal(18,2)")
    stored = store.claim_store(claims, "vin", CALENDAR, ["DC", "AB"], 2)
    days = [day("2020-01-30") + dt.timedelta(days=d) for d in range(120)]
    events = spark.createDataFrame(
        [(n, v, d) for n, (v, d) in enumerate([(v, d) for v in "abz" for d in days]
                                               + [(None, days[50]), ("a", None), ("a", days[60])])],
        "n long, vin string, ver_eff date")
    names = store.loss_feature_names(["vin"], ["DC", "AB"], 2)
    nested = {c: store.nested_claim_store(stored, "vin", c) for c in ("DC", "AB")}
    found = store.nested_features(events, nested, "vin", names, "total")
    wide = store.point_in_time_features(events, {"vin": stored}, ["DC", "AB"], 2)
    want = wide.withColumn("total", sum((F.col(c) for c in names[1:]), F.col(names[0])))
    keys = ["n", "vin", "ver_eff", "total", *names]
    assert rows(found, *keys) == rows(want, *keys)
    assert found.filter("total > 0").count() > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the maps meet months, not days: days are reduced before the first join with them
    assert "Aggregate [vin" in plan and plan.count("_seen") > 1


def test_retro_losses_are_compiled_and_keep_negative_totals(spark, capsys):
    claims = spark.createDataFrame(
        [("a", "DC", "1", day("2020-03-10"), Decimal("2.50")),
         ("a", "DC", "2", day("2020-02-10"), Decimal("-7.99")),
         ("b", "DC", "3", day("2020-03-10"), Decimal("0.99")), ("c", "DC", "4", day("2020-03-10"), None)],
        "vin string, cvg string, int_claim_num string, loss_dt date, loss_sum decimal(18,2)")
    out = retro_losses(claims, "vin", MonthEnds("2020-03-31", "2020-04-30"), ["DC"], 2)
    out.explain()
    assert "lambda" not in capsys.readouterr().out  # functions over arrays are interpreted
    got = {(r["vin"], str(r["dt"])): (r["bins"], r["acum"]) for r in out.collect()}
    assert got == {("a", "2020-03-31"): ([2, -7, 0], [2, -5, -5]),
                   ("a", "2020-04-30"): ([0, 2, -7], [0, 2, -5])}
