"""Long plans are evaluated once, and rows travel narrow."""

from __future__ import annotations

import time
from decimal import Decimal

from pyspark.sql import functions as F

from hindcast.operators import reliable
from hindcast.plans import exposure, history
from tests.helpers import day, rows
from workloads import inputs, score_queries

PARTY = ("P1", "V1", "D1")
SESSION = ("policy_num string, vin string, dln string, term_eff date, term_days int, ver_eff date, "
           "ver_exp date, ver_days int, session_prem decimal(18,2)")
CLAIM = ("policy_num string, int_claim_num string, loss_dt date, cvg string, "
         "loss_sum decimal(28,2), dln string, vin string")


def _tables(spark, tmp_path, monkeypatch):
    sessions = [
        (*PARTY, day("2000-01-01"), 365, day(a), day(b), 30, None)
        for a, b in (("2000-01-01", "2000-01-31"), ("2000-02-01", "2000-02-29"))
    ]
    claims = [("P1", "C1", day("2000-01-10"), "DC", Decimal(5), "D1", "V1")]
    for name, found, schema in (("sessions", sessions, SESSION), ("claims_long", claims, CLAIM)):
        path = str(tmp_path / name)
        spark.createDataFrame(found, schema).write.parquet(path)
        monkeypatch.setattr(inputs, name, lambda *_, path=path: spark.read.parquet(path))


def test_labels_are_built_from_stored_inputs(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path, monkeypatch)
    out = inputs.labelled(spark, "")
    assert all("scratch-" in f for f in out.inputFiles())
    assert [(str(d), float(x)) for d, x in rows(out, "ver_eff", "DC_loss")] == [
        ("2000-01-10", 5.0), ("2000-02-01", 0.0)]


def test_session_losses_are_built_from_stored_sessions(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path, monkeypatch)
    out = inputs.session_losses(spark, "")
    assert not any("/sessions/" in f for f in out.inputFiles())
    assert [float(x) for x, in rows(out.orderBy("ver_eff"), "session_loss_DC")] == [0.0, 5.0]


def test_time_split_reads_a_stored_table(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path, monkeypatch)
    labelled = str(tmp_path / "labelled")
    inputs.labelled(spark, "").write.parquet(labelled)
    monkeypatch.setattr(inputs, "labelled", lambda *_: spark.read.parquet(labelled))
    out = score_queries.split_time(spark, "")
    assert all("scratch-" in f for f in out.inputFiles())
    assert [str(r["ver_eff"]) for r in out.filter("is_validation").collect()] == ["2000-02-01"]


def test_sessions_need_one_shuffle(spark, capsys):
    made = spark.createDataFrame(
        [("P1", "V1", "D1", day("2000-01-01"), 365, day("2000-01-01"), day("2000-02-01"), "primary",
          1, 100, 1)] * 2,
        "policy_num string, vin string, dln string, term_eff date, term_days int, ver_eff date, "
        "ver_exp date, driver_type string, expos_num int, ft_prem int, loaded_timest int")
    out = exposure.exposure_sessions([made], "1999-01-01", "2001-01-01")
    out.explain()
    assert capsys.readouterr().out.count("Exchange ") == 1
    assert out.count() == 1


def test_earlier_terms_travel_as_one_array(spark, capsys):
    made = spark.createDataFrame(
        [(*PARTY, day(f"{y}-01-01"), 365, day(f"{y}-01-01"), day(f"{y}-02-01"), 31, 10 * y)
         for y in (1998, 1999, 2000)],
        SESSION.replace("decimal(18,2)", "int"))
    made = made.selectExpr("*", "cast(1 as decimal(18,2)) as session_loss_DC")
    events = made.select("policy_num", "vin", "dln", "ver_eff", "term_eff")
    out = history.add_previous_terms(events, made, coverages=("DC",))
    for kk in ("vin", "dln", "policy_num"):
        alone = history.previous_terms(events, history.term_aggregates(made, kk, ("DC",)), kk)
        named = [c for c in alone.columns if c not in (kk, "term_eff")]
        assert set(named) <= set(out.columns)
        assert rows(out, kk, "term_eff", *named) == rows(alone, kk, "term_eff", *named)
    out.explain()
    assert "_terms_policy_num" in capsys.readouterr().out
    assert any("scratch-" in f for f in out.inputFiles())


def test_stored_tables_leave_no_shuffles_behind(spark):
    trackers = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()

    def shuffled():
        found = trackers.diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())
                if found.apply(i).getName().startswith("shuffle_")}

    def counted(n):
        return spark.range(0, 1000, 1, 4).groupBy((F.col("id") % n).alias("k")).count()

    before = spark.conf.get(reliable._DROP_SHUFFLES)
    for i, keep in enumerate((reliable.checkpointed, reliable.stored)):
        plan, known = counted(7 + i), shuffled()
        kept = keep(plan)
        assert wait_until(lambda: not shuffled() - known)
        assert kept.count() == plan.count() == 7 + i
    assert spark.conf.get(reliable._DROP_SHUFFLES) == before


def wait_until(holds, seconds=20):
    end = time.time() + seconds
    while not holds() and time.time() < end:
        time.sleep(0.2)
    return holds()
