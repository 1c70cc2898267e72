"""A stage of the pipeline bounds what its Python workers hold, also when it runs alone."""

from __future__ import annotations

import corpus_pipeline
from hindcast.llm import toxicity

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_each_stage_sets_the_size_of_batches(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame(
        [(i, f"{words} {i}", "a" if i % 2 else "b") for i in range(12)],
        "doc_id long, text string, source string")
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind is here at all")], "item_id long, text string"
                          ).write.parquet(f"{tmp_path}/benchmark.parquet")
    before = {name: spark.conf.get(name) for name in corpus_pipeline.BATCHES}
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(ROWS, "10000")
            stage(spark, docs, str(tmp_path))
            assert name == "mixing" or spark.conf.get(ROWS) == "1000"  # mixing has no Python worker
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_no_task_of_the_fit_holds_two_python_workers(spark, monkeypatch):
    seen = []

    def fit(sample, features):
        seen.append(sample._jdf.queryExecution().toString())
        return toxicity.Severity({}, (20.0,))

    monkeypatch.setattr(toxicity, "fit_severity", fit)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    toxicity.severity_model(docs, labels)
    assert seen and "MapInArrow" not in seen[0]
