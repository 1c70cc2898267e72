import random

import pytest


@pytest.fixture(autouse=True)
def _ship(spark):
    from hindcast.llm.common import ship_package

    ship_package(spark)


@pytest.fixture()
def make(spark):
    """Documents from texts: ids 0, 1, ...; or from (id, text) pairs; extra columns that clash."""

    def documents(texts, **extra):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"s{n % 3}", 7, "x", 1) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, "
                  "size string, n int").repartition(3)

    return documents


@pytest.fixture()
def prose():
    rng = random.Random(5)
    words = ["w" + str(i) for i in range(4000)]

    def text(n, salt=None):
        r = random.Random(salt) if salt is not None else rng
        return " ".join(r.choice(words) for _ in range(n))

    return text
