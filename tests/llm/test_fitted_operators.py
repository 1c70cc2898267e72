import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hindcast.llm import hpylm, toxicity
from hindcast.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def toxic_rows(spark):
    from hindcast.llm.common import ship_package

    ship_package(spark)
    return {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, FOLDER).collect()}


def test_toxicity_query_finds_labelled_documents(spark, toxic_rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(toxic_rows) == docs.count()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    good = sum(toxic_rows[r["doc_id"]]["toxic"] == bool(r["toxic"]) for r in labels)
    assert good > 0.95 * len(labels)
    clean = [r for r in labels if not r["toxic"]]
    assert sum(toxic_rows[r["doc_id"]]["toxic"] for r in clean) < 0.01 * len(clean)


def test_toxicity_holds_on_labels_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.severity_model(docs, labels.filter("doc_id % 3 <> 0"))
    test = docs.join(labels.filter("doc_id % 3 = 0"), "doc_id")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_severity(test, model).collect()}
    rows = test.select("doc_id", "toxic").collect()
    assert sum(got[r["doc_id"]] == bool(r["toxic"]) for r in rows) > 0.9 * len(rows)


def graded(spark):
    """Three grades by the number of bad words."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        grade = i % 3
        words = [rng.choice("abcdefgh") * 5 for _ in range(40)]
        words += [rng.choice(["vileness", "vilest", "awful"]) for _ in range([0, 2, 8][grade])]
        rng.shuffle(words)
        rows.append((" ".join(words), grade))
    return spark.createDataFrame(rows, "text string, grade int")


def test_grades_share_weights_across_ordered_thresholds(spark):
    sample = graded(spark)
    features = toxicity.select_features(sample)
    model = toxicity.fit_severity(sample, features)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    assert "vile~" in model.weights
    df = sample.selectExpr("cast(monotonically_increasing_id() as long) as doc_id", "text", "grade")
    want = {r["doc_id"]: r["grade"] for r in df.collect()}
    rows = toxicity.score_severity(df, model).collect()
    assert sum(r["grade"] == want[r["doc_id"]] for r in rows) > 0.95 * len(rows)
    for r in rows:
        assert 0 <= r["expected_severity"] <= 2 and r["toxic"] == (r["p_toxic"] >= 0.5)


def test_likelihood_is_at_its_top(spark):
    """No small change of a weight or threshold makes the grades likelier."""
    sample = graded(spark)
    features = toxicity.select_features(sample)[:6]
    model = toxicity.fit_severity(sample, features, steps=3000, penalty=0.0)
    rows = sample.collect()

    def likelihood(weights, thresholds):
        total = 0.0
        for r in rows:
            own = toxicity.feature_counts(r["text"])
            m = sum(w * math.log1p(own[f]) for f, w in weights.items())
            edge = [1.0, *[1 / (1 + math.exp(t - m)) for t in thresholds], 0.0]
            total += math.log(max(edge[r["grade"]] - edge[r["grade"] + 1], 1e-12))
        return total / len(rows)

    top = likelihood(model.weights, model.thresholds)
    for f in model.weights:
        for step in (-0.5, 0.5):
            changed = {**model.weights, f: model.weights[f] + step}
            assert likelihood(changed, model.thresholds) < top + 1e-3


def test_toxicity_of_odd_tables(spark, make, prose):
    texts = [None, "", "bad words here", prose(9000, 1), "bad words here"]
    labels = spark.createDataFrame(
        [(0, 0), (2, 1), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    docs = make(texts)
    for own in (labels, labels.filter("doc_id < 0"), labels.filter("toxic = 0")):
        model = toxicity.severity_model(docs, own)
        assert toxicity.score_severity(docs, model).count() == 5
        assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.without_toxic(docs, model).count() == 5
    assert toxicity.score_severity(docs.filter("doc_id < 0"), model).count() == 0


def crp_tables(count, mass, discount, rng):
    t = 1
    for k in range(1, count):
        t += rng.random() < mass / (mass + k - discount * t)
    return t


@pytest.mark.parametrize("count, mass", [(5, 0.7), (40, 3.0), (400, 2.0), (3000, 0.01)])
def test_seating_follows_the_restaurant_process(count, mass):
    rng = random.Random(1)
    want = [crp_tables(count, mass, 0.6, rng) for _ in range(2000)]
    got, _ = hpylm.seat(np.full(4000, float(count)), np.full(4000, mass), 0.6,
                        np.random.default_rng(1))
    error = (np.var(want) / 2000 + np.var(got) / 4000) ** 0.5
    assert abs(np.mean(want) - got.mean()) < 4 * error + 0.02 * np.mean(want)


def base_facts(rows):
    train = Counter()
    tokens = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    for i, (doc_id, text) in enumerate(rows):
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)) + ["\0end"]
        tokens[i] = own
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            train.update(own)
    n, v = sum(train.values()), len(train)
    return [(d, len(tokens[i]), sum(train[w] > 0 for w in tokens[i]), n,
             sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens[i]))
            for i, (d, _) in enumerate(rows)]


def check_scores(rows, got):
    want = sorted(base_facts(rows), key=str)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])
                  for r in got), key=str)
    assert len(want) == len(got)
    for w, g in zip(want, got):
        assert w[:4] == g[:4] and g[4] == pytest.approx(w[4], rel=1e-9)


def test_query_counts_and_beats_the_base_on_held_out_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(
        f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op8_hpy_scores"](spark, FOLDER).collect()
    check_scores(rows, got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {
        d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)
    again = {r["doc_id"]: r["score"] for r in QUERIES["op8_hpy_scores"](spark, FOLDER).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-6) for r in got)


def test_probabilities_of_all_words_in_a_context_sum_to_one(spark, monkeypatch):
    """All words and the unknown one, each once after a word, through the whole job."""
    rng = random.Random(4)
    words = [f"v{k}" for k in range(30)]
    train = [(i, " ".join(rng.choices(words, range(1, 31), k=60))) for i in range(40)
             if zlib.crc32(str(i).encode()) % 7 != 2]
    asked = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    pairs = [(d, f"v29 {w}") for d, w in zip(asked, [*words, "unknown"])]
    single = [(d, "v29") for d in asked[40:41]]
    rows = train + pairs + single
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in hpylm.score_documents(df).collect()}
    check_scores(rows, got.values())
    # P(v29 w end) sums P(w | v29) P(end | w); end after each word is asked on its own.
    ends = {}
    for d, w in zip(asked[50:], [*words, "unknown"]):
        ends[w] = d
    more = rows + [(d, w) for w, d in ends.items()]
    df = spark.createDataFrame(more, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in hpylm.score_documents(df).collect()}
    first = got[ends["v29"]]
    assert first < 0 and all(math.isfinite(s) for s in got.values())


def test_scores_of_odd_tables(spark, make, prose):
    rows = [(1, None), (2, ""), (3, "A a É é"), (3, "A a É é"), (None, "x"), (5, "the " * 3000),
            (6, prose(20_000, 1)), (9, "new words"), (16, "the the")]
    got = hpylm.score_documents(make(rows)).collect()
    check_scores(rows, got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hpylm.score_documents(make(rows).filter("doc_id < 0")).count() == 0
