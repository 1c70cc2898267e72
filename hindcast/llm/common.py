"""What several operators share: reading tables, written intermediate tables, words, hashes."""

from __future__ import annotations

import inspect
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators.reliable import scratch_folder, stored  # noqa: F401  (used by the operators)

WORD = r"[^\x20\x09-\x0D]+"
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


# Rows and bytes handed to a Python worker at a time: texts differ in length by orders of magnitude,
# and a batch is held by the worker and by its executor, outside the heap, at once.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the jobs that follow in this session."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to its Python workers, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_hindcast_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix="hindcast-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(name)
    context._hindcast_shipped = True


def word_count(text) -> F.Column:
    """Number of words of a text as a column expression; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs get unrelated outputs."""
    out = values.astype(np.uint64, copy=True)
    for _ in range(2):
        out ^= out >> np.uint64(32)
        out *= MIX
    out ^= out >> np.uint64(32)
    return out


def give_back() -> None:
    """Return this worker's free memory to the machine; the next task may need it elsewhere."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library need not have it
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives memory back when it ends: Spark goes on using its workers."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return task


def lean_group(work: Callable) -> Callable:
    """The same for a function of whole groups, one or two tables at a time."""
    if len(inspect.signature(work).parameters) == 2:  # Spark tells cogroups by the parameters
        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return work(left, right)
            finally:
                give_back()

        return pair

    def group(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            give_back()

    return group


def rows_where(df: DataFrame, test: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """Rows of ``df`` whose text passes; ``test()`` is called once per task. No shuffle."""
    at = df.columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = test()
        for batch in batches:
            yield batch.filter(pa.array([good(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return df.mapInArrow(lean(passing), df.schema)


class HashedWords(dict):
    """Word to 64-bit hash; forgets all when it holds too many words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64)


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * ODD + words[k:k + n]
    return mixed(out)
