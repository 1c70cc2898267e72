"""Every registered query next to its SQL on the smallest tables, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from workloads.compare import compare
from workloads.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# Fits are covered by test_models; running them here would only repeat the training.
FITS = {"coverage_models", "tweedie_model", "classifier", "huber_model", "cv_grid",
        "feature_ranking", "ablation_runs"}
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
            "MapInPandas", "FlatMapGroups")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_query_equals_its_sql_without_pairing_or_python(spark, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [x for x in UNWANTED if x in plan] == []
    if name in ORACLES:
        assert compare(lambda *_: df, ORACLES[name], spark, FOLDER) == ""
    else:
        assert len(df.collect()) > 0  # all columns are made, not only counted


def test_the_comparison_notices_a_difference(spark):
    build, oracle = QUERIES["policy_region"], ORACLES["policy_region"]
    assert "rows" in compare(build, oracle + " WHERE policy_num <> 'P1'", spark, FOLDER)
    assert "columns" in compare(build, f"SELECT *, 1 AS more FROM ({oracle})", spark, FOLDER)
    changed = f"SELECT * REPLACE (policy_province || '' AS prov_cd) FROM ({oracle})"
    assert "differ" in compare(build, changed, spark, FOLDER)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["claims_latest"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "(l_returnflag,R)" in plan
    assert "l_discount" not in plan and "l_tax" not in plan


def test_exposures_are_read_once_and_dealt_a_few_times(spark):
    plan = QUERIES["exposure_sessions"](spark, FOLDER)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("FileScan") <= 3 and text.count("Exchange hashpartitioning") <= 5
    assert "Join" not in text


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["policy_num", "vin", "dln", "ver_eff"]
    assert df.count() > 0
