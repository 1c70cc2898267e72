"""From raw documents to a token file, in five stages; each reads what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hindcast.llm import decontamination, jaccard, mixing, token_files, toxicity
from hindcast.llm.common import ship_package, stored, table
from hindcast.operators.reliable import scratch_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# Texts differ in length by orders of magnitude, and the workers of one executor share its memory with
# the stages before and after: rows and bytes handed to a Python worker at a time.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}
REMEMBERED = 100_000  # pieces an encoder remembers; four stages have used the memory before it


def prepared(spark: SparkSession) -> None:
    """What each stage needs of the session, since a stage may run without the ones before."""
    ship_package(spark)
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the severity model, fitted on the labelled ones, calls toxic."""
    prepared(spark)
    model = toxicity.severity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near duplicates."""
    prepared(spark)
    return jaccard.one_per_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold half of a benchmark item or more, in any order of passages."""
    prepared(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their target weights."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token file and describe it: one row per document, read back from the file."""
    prepared(spark)
    folder = scratch_folder(docs)
    token_files.write_token_file(docs, folder, TOKENIZER, remember=REMEMBERED, keep=False)
    return token_files.read_token_file(spark, folder)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_file", write_tokens),
]

# Fitted models and the tokenizer are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
