import pytest

from hindcast import sources
from tests.helpers import rows


def test_delimited_scans(spark, tmp_path):
    (tmp_path / "prov.txt").write_text("1|CA|Ontario|35|ON|East|E\n2|CA|Alberta|48|AB|West|W\n")
    prov = sources.read_delimited(
        spark, str(tmp_path / "prov.txt"), sources.province_dim_schema(), sep="|"
    )
    assert rows(prov, "prov_code", "prov_abbrev") == [("35", "ON"), ("48", "AB")]
    (tmp_path / "cov.txt").write_text(
        "line_of_business,line_type,line_type_desc,cvg_type_cd,modeling_id_cl\nAUTO,1,x,T1,DC\n"
    )
    cov = sources.read_delimited(
        spark, str(tmp_path / "cov.txt"), sources.coverage_map_schema(), header=True
    )
    assert rows(cov) == [("AUTO", 1, "x", "T1", "DC")]
    (tmp_path / "clicks.tsv").write_text("1\t" + "\t".join([""] * 13) + "\t" + "\t".join(["a"] * 26) + "\n")
    clicks = sources.read_delimited(
        spark, str(tmp_path / "clicks.tsv"), sources.click_log_schema(), sep="\t"
    )
    assert len(clicks.columns) == 40
    assert rows(clicks, "label", "I1", "C26") == [(1, None, "a")]


def test_strings_are_cast_leniently(spark, tmp_path):
    (tmp_path / "scores.csv").write_text("policy_number,xgb_a\nP1,1.5\nP2,oops\n\n")
    df = sources.read_strings(
        spark, str(tmp_path / "scores.csv"), ["policy_number", "xgb_a"], ["xgb_a"]
    )
    assert rows(df) == [("P1", 1.5), ("P2", None)]


def test_parts_are_read_together(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.csv").write_text(f"a,b\n{i},x\n")
    df = sources.read_csv_parts(spark, str(tmp_path / "*.csv"), "a int, b string")
    assert rows(df, "a") == [(0,), (1,), (2,)]


def test_rerun_replaces_only_its_partitions(spark, tmp_path):
    path = sources.store_path(str(tmp_path) + "/", "claims")
    assert path == f"{tmp_path}/claims"
    first = spark.createDataFrame([("vin", "DC", 1), ("vin", "AB", 2)], "kk string, cvg string, v int")
    sources.overwrite_partitions(first, path, ["kk", "cvg"])
    again = spark.createDataFrame([("vin", "DC", 9)], "kk string, cvg string, v int")
    sources.overwrite_partitions(again, path, ["kk", "cvg"])
    assert rows(sources.read_parquet(spark, path), "cvg", "v") == [("AB", 2), ("DC", 9)]
    sources.write_table(again, f"{tmp_path}/plain")
    assert rows(sources.read_parquet(spark, f"{tmp_path}/plain"), "v") == [(9,)]


def test_tables_and_samples(spark, tmp_path):
    spark.range(10000).createOrReplaceTempView("numbers")
    df = sources.read_table(spark, "numbers")
    sample = sources.sample_rows(df, 0.1, seed=5)
    assert 800 < sample.count() < 1200
    assert rows(sample) == rows(sources.sample_rows(df, 0.1, seed=5))
    df.write.parquet(f"{tmp_path}/t")
    assert sources.read_table(spark, "t", "parquet", path=f"{tmp_path}/t").count() == 10000


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from hindcast.operators import reliable

    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, _):
            return self.folder

    class Context:
        master = "spark://somewhere"

        def __init__(self, folder=None):
            self.conf, self.set = Conf(folder), None

        def getCheckpointDir(self):
            return self.set

        def getConf(self):
            return self.conf

        def setCheckpointDir(self, folder):
            self.set = folder

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        reliable._use_checkpoint_folder(Context())
    named = Context("/shared/folder")
    reliable._use_checkpoint_folder(named)
    assert named.set == "/shared/folder"


def test_header_names_decide_on_columns(spark, tmp_path):
    (tmp_path / "turned.csv").write_text("b,a\nx,1\n")
    strings = sources.read_strings(spark, str(tmp_path / "turned.csv"), ["a", "b"], ["a"])
    assert rows(strings, "a", "b") == [(1.0, "x")]
    with pytest.raises(Exception, match="[Hh]eader"):
        sources.read_delimited(
            spark, str(tmp_path / "turned.csv"), "a string, b string", header=True).collect()


def test_exposure_stores_of_two_ids_are_kept_apart(spark, tmp_path):
    from hindcast.plans import store

    one = spark.createDataFrame([("V1", "2020-01-31", 7, 2, 3)],
                                "vin string, dt string, prem_sum long, cntdist_dln long, cntdist_policy_num long")
    two = spark.createDataFrame([("D1", "2020-01-31", 8, 4, 5)],
                                "dln string, dt string, prem_sum long, cntdist_vin long, cntdist_policy_num long")
    store.save_exposure_store(one, "vin", str(tmp_path))
    store.save_exposure_store(two, "dln", str(tmp_path))
    back = store.load_exposure_store(spark, "vin", str(tmp_path))
    assert rows(back, *one.columns) == rows(one)
    assert rows(store.load_exposure_store(spark, "dln", str(tmp_path)), *two.columns) == rows(two)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kk" in plan and "vin)" in plan
