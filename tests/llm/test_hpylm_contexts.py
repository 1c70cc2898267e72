import math
import zlib

import numpy as np

from hindcast.llm import hpylm
from hindcast.llm.common import HashedWords, stored


def two_words_of_one_class():
    """Two words whose hashes agree in their first 12 bits."""
    hashed, seen = HashedWords(), {}
    for k in range(100_000):
        word = f"u{k}"
        kind = int(hashed[word.encode()]) >> 52
        if kind in seen:
            return seen[kind], word
        seen[kind] = word


def ids(held, start=0):
    return (i for i in range(start, 10 ** 6) if (zlib.crc32(str(i).encode()) % 7 == 2) == held)


def test_each_word_is_a_context_of_its_own(spark):
    """After one word always comes a, after another of its hash class always b."""
    one, other = two_words_of_one_class()
    train, held = ids(False), ids(True)
    rows = [(next(train), f"{one} a") for _ in range(200)]
    rows += [(next(train), f"{other} b") for _ in range(200)]
    right, wrong = next(held), next(held)
    rows += [(right, f"{one} a"), (wrong, f"{one} b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in hpylm.score_documents(df).collect()}
    # Whatever comes first and last is alike in both.
    assert got[right] - got[wrong] > 1.0


def test_a_frequent_word_is_spread_over_parts(spark, monkeypatch):
    """Scores do not depend on it but for sampling, and no part gets most of the word."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"the x{k}" for k in rng.zipf(1.3, 60) % 900)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r["doc_id"]: r for r in hpylm.score_documents(df).collect()}
    monkeypatch.setattr(hpylm, "PART_TOKENS", 2000)
    split = {r["doc_id"]: r for r in hpylm.score_documents(df).collect()}
    assert whole.keys() == split.keys()
    for k, r in whole.items():
        assert r["n_known"] == split[k]["n_known"]
        assert math.isclose(r["base_score"], split[k]["base_score"], rel_tol=1e-9)
    total = [sum(r["score"] for r in x.values()) for x in (whole, split)]
    assert math.isclose(*total, rel_tol=0.02)

    the = HashedWords()[b"the"]
    out = stored(hpylm.gathered(hpylm.token_blocks(df, np.array([the], dtype=np.uint64), 24)))
    counts, contexts = {}, []
    for r in out.filter(f"kind = {hpylm.CELLS}").collect():
        part = hpylm.Part(r.asDict(), 0)
        mine = part.words[part.word] == the
        if mine.any():
            counts[r["part"]] = int(mine.sum())
            contexts += part.contexts[part.context[mine]].tolist()
    assert len(counts) > 12 and max(counts.values()) < 0.2 * sum(counts.values())
    assert len(contexts) == len(set(contexts))
