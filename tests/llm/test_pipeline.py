"""Each stage on what the one before has kept, against a plain version of it."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hindcast.llm import decontamination, mixing, toxicity
from hindcast.llm.common import stored
from tests.llm.test_near_copies import brute as near_copies
from tests.llm.test_token_files import brute as token_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Inputs and outputs of all stages."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, FOLDER))
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stages_keep_the_columns_and_are_registered(spark, steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert list(steps) == names and len(names) == 5
    for name in names[:-1]:
        before, after = steps[name]
        assert after.dtypes == before.dtypes
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


def test_toxic_documents_go(spark, steps):
    before, after = steps["toxicity"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = toxicity.score_severity(before, toxicity.severity_model(before, labels))
    assert ids(after) == ids(scores.filter("not toxic"))
    assert 0 < after.count() < before.count()


def test_one_document_of_each_group_stays(steps):
    before, after = steps["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == sorted({c for _, c, *_ in near_copies(rows)})


def test_contaminated_documents_go(spark, steps):
    before, after = steps["decontamination"]
    pairs = decontamination.contamination(
        before, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert ids(after) == sorted(set(ids(before)) - set(ids(pairs)))


def test_sources_reach_their_targets(steps):
    before, after = steps["mixing"]
    copies = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    for r in mixing.mix(before).collect():
        assert copies.get(r["doc_id"], 0) == (int(r["taken"] / r["size"] + 0.5) if r["size"] else 0)


def test_the_token_file_holds_all_that_is_left(steps):
    before, after = steps["token_file"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert sorted(tuple(r) for r in after.collect()) == token_rows(rows)


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
    assert docs.count() == 0
