"""Cutting lineage with data that outlives an executor."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _use_checkpoint_folder(context: SparkContext) -> None:
    if context.getCheckpointDir() is not None:
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        # One process on one machine only; "local-cluster" has executors of its own.
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="hindcast-checkpoint-")
    context.setCheckpointDir(folder)


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What an action shuffles leaves the disk when it ends; else it stays until the driver collects
    garbage, so the steps of a job add up. A plan that is run a second time shuffles again."""
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from there.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder; on a cluster its absence is an error.
    """
    _use_checkpoint_folder(df.sparkSession.sparkContext)
    with _dropping_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan made under the setting


def scratch_folder(df: DataFrame) -> str:
    """A new folder name next to the checkpoints, for data that one job writes and reads back."""
    context = df.sparkSession.sparkContext
    _use_checkpoint_folder(context)
    return f"{context.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet next to the checkpoints and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. The files live in the
    folder named by ``spark.checkpoint.dir``; see the README for cleaning it. Smaller on disk than
    :func:`checkpointed`, and later readers take the columns they need.
    """
    folder = scratch_folder(df)
    with _dropping_shuffles(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
