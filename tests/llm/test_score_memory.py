"""What a worker holds while it cuts documents into blocks."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import hpylm


class Caught:
    """Stands for a table and its columns; keeps the function that would run on the rows."""

    def select(self, *_):
        return self

    col = cast = select

    def mapInArrow(self, work, _):  # noqa: N802
        self.work = work
        return self

    get = select

    def partitionId(self):  # noqa: N802
        return 0


@pytest.fixture
def peak():
    tracemalloc.start()
    yield lambda: tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()


def test_a_block_is_cut_with_one_copy_of_its_tokens(peak, monkeypatch):
    caught = Caught()
    monkeypatch.setattr(hpylm, "F", caught)
    monkeypatch.setattr(hpylm, "TaskContext", caught)
    hpylm.token_blocks(caught, np.array([], dtype=np.uint64), 24)
    n, each = 400, 1000
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(map(str, rng.integers(0, 500, each))) for _ in range(n)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), texts], names=["doc_id", "text"])
    tracemalloc.reset_peak()
    out = list(caught.work(iter([batch])))
    assert sum(b.num_rows for b in out) > 1
    assert peak() < 50 * n * each  # bytes a token


def test_scoring_bounds_its_batches(spark):
    names = [f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes")]
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.unset(name)
        hpylm.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
        rows, size = (spark.conf.get(name) for name in names)
        assert int(rows) <= 1000 and int(size.rstrip("Bb")) <= 4 * 2 ** 20
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
