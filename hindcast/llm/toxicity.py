"""Severity of toxic text by cumulative-link ordinal regression on sparse text features.

Features of a text are its words and the first 4 to 8 letters of its longer words (an abusive stem
keeps its weight when inflected), each as log(1 + count). Grades 0 < 1 < ... < K - 1 share one
weight vector w; P(grade > k) = sigmoid(w.x - theta_k) with theta_0 < theta_1 < ... . The expected
severity is the sum of these probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import lean, rows_where, stored

STRIP = ".,;:!?\"'()[]{}«»#*$%&|<>-_"


def features_of_word(word: str) -> list[str]:
    """The word without marks around it, and its prefixes of 4 to 8 letters as ``prefix~``."""
    word = word.strip(STRIP)
    if not word:
        return []
    return [word] + [word[:n] + "~" for n in range(4, 9) if len(word) > n]


def word_counts(text: str | None) -> Counter:
    return Counter((text or "").lower().split())


def feature_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in word_counts(text).items():
        for feature in features_of_word(word):
            out[feature] += n
    return out


@dataclass(frozen=True)
class Severity:
    """Weights by feature, one threshold per step between neighbouring grades."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and each k."""
        z = np.asarray(margin, dtype=float)[:, None] - np.array(self.thresholds)[None, :]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, grade: str, rows: int = 20_000
) -> DataFrame:
    """Texts of at most ``rows`` labelled documents with their ``grade``.

    The sample bound is a documented parameter: the first ``rows`` labels by a hash of the id, each
    id once (its largest grade). Labels without id, grade or document are left out.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(grade).isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(grade).cast("int")).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = documents.select("doc_id", "text")
    return texts.join(F.broadcast(sample), "doc_id")  # bounded by ``rows`` ids


def _present(df: DataFrame) -> DataFrame:
    """Rows (feature, grade, n): in how many texts of a batch a feature occurs, by grade."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, grade in zip(batch.column(0), batch.column(1)):
                grade = grade.as_py()
                seen.update((f, grade) for f in feature_counts(text.as_py()))
                if len(seen) > 100_000:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    def rows(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], type=pa.string()),
             pa.array([k[1] for k in seen], type=pa.int32()),
             pa.array(list(seen.values()), type=pa.int64())], names=["feature", "grade", "n"])

    return df.select("text", "grade").mapInArrow(lean(count), "feature string, grade int, n long")


def select_features(sample: DataFrame, most: int = 4_096, least_z: float = 5.0) -> list[str]:
    """Features whose share of texts differs most between grade 0 and all higher grades.

    Ranked by the two-proportion z statistic; at least 5 texts and ``least_z`` standard errors.
    Ties go to the feature that sorts first. The result is bounded by ``most``.
    """
    totals = sample.groupBy((F.col("grade") > 0).alias("toxic")).count().collect()  # two rows
    n = {bool(r["toxic"]): r["count"] for r in totals}
    if len(n) < 2:
        return []
    counts = _present(sample).groupBy("feature").agg(
        F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("grade") > 0, 0).otherwise(F.col("n"))).alias("b"),
    ).filter("a + b >= 5")
    both = (F.col("a") + F.col("b")) / (n[True] + n[False])
    spread = F.sqrt(both * (1 - both) * (1 / n[True] + 1 / n[False]))
    z = F.abs(F.col("a") / n[True] - F.col("b") / n[False]) / spread
    best = counts.withColumn("z", F.when(spread > 0, z).otherwise(0.0)).filter(
        F.col("z") >= least_z).orderBy(F.col("z").desc(), "feature").limit(most)
    return [r["feature"] for r in best.select("feature").collect()]


def fit_severity(sample: DataFrame, features: list[str], steps: int = 400,
                 penalty: float = 1e-4) -> Severity:
    """Maximum likelihood by gradient steps on the sample's rows, reduced to ``features``.

    ``sample`` is bounded (see ``labelled_sample``) and only non-zero selected features are
    collected. With a single grade, or without features, every text gets the prior.
    """
    index = {f: i for i, f in enumerate(features)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = [], []
            for text in batch.column(0):
                own = Counter()
                for f, c in feature_counts(text.as_py()).items():
                    if f in index:
                        own[index[f]] += c
                at.append(list(own))
                value.append([math.log1p(c) for c in own.values()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(at, type=pa.list_(pa.int32())),
                 pa.array(value, type=pa.list_(pa.float64()))], names=["grade", "at", "value"])

    rows = stored(sample.select("text", "grade").mapInArrow(
        lean(sparse), "grade int, at array<int>, value array<double>"
    )).orderBy("grade", "at", "value").collect()  # the sort reads its input twice
    grade = np.array([r["grade"] for r in rows], dtype=int)
    top = int(grade.max()) if len(grade) else 0
    if top == 0:
        return Severity({}, (20.0,))
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.array([i for r in rows for i in r["at"]], dtype=int)
    value = np.array([v for r in rows for v in r["value"]], dtype=float)
    # P(grade > k) - P(grade > k + 1) is the likelihood of a grade; thresholds stay in order because
    # each is the one before plus an exponential.
    share = np.array([max((grade > k).mean(), 1e-6) for k in range(top)])
    start = -np.log(share / (1 - np.minimum(share, 1 - 1e-6)))
    params = np.concatenate([np.zeros(len(features)), start[:1],
                             np.log(np.maximum(np.diff(start), 0.1))])
    speed = np.zeros_like(params)
    moment = np.zeros_like(params)
    k = len(features)

    def thresholds(p):
        return np.cumsum(np.concatenate([p[k:k + 1], np.exp(p[k + 1:])]))

    for step in range(1, steps + 1):
        theta = thresholds(params)
        margin = np.bincount(row, weights=value * params[at], minlength=len(rows))
        s = 1 / (1 + np.exp(-np.clip(margin[:, None] - theta[None, :], -40, 40)))
        edge = np.concatenate([np.ones((len(rows), 1)), s, np.zeros((len(rows), 1))], axis=1)
        slope = edge * (1 - edge)
        each = np.arange(len(rows))
        upper, lower = edge[each, grade], edge[each, grade + 1]
        like = np.maximum(upper - lower, 1e-12)
        d_margin = (slope[each, grade] - slope[each, grade + 1]) / like
        d_theta = np.zeros(top)
        for t in range(top):
            d_theta[t] = (np.sum(slope[:, t + 1] / like * (grade == t))
                          - np.sum(slope[:, t + 1] / like * (grade == t + 1)))
        gradient = np.zeros_like(params)
        gradient[:k] = np.bincount(at, weights=value * d_margin[row], minlength=k) / len(rows)
        gradient[:k] -= penalty * params[:k]
        gradient[k] = d_theta.sum() / len(rows)
        for t in range(1, top):
            gradient[k + t] = d_theta[t:].sum() * np.exp(params[k + t]) / len(rows)
        moment = 0.9 * moment + 0.1 * gradient
        speed = 0.999 * speed + 0.001 * gradient ** 2
        params += 0.1 * (moment / (1 - 0.9 ** step)) / (np.sqrt(speed / (1 - 0.999 ** step)) + 1e-8)
    return Severity({f: float(w) for f, w in zip(features, params) if w},
                    tuple(float(t) for t in thresholds(params)))


def grade_by_markers(sample: DataFrame, features: list[str], toxic: str, severe: int = 3
                     ) -> DataFrame:
    """Three grades from a yes/no label: 0 not toxic, 1 toxic, 2 toxic with ``severe`` markers.

    Markers are those of the 64 strongest selected features that are whole words.
    """
    markers = frozenset(f for f in features[:64] if not f.endswith("~"))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                hits = sum(n for f, n in feature_counts(text.as_py()).items() if f in markers)
                out.append(0 if not label else 2 if hits >= severe else 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, type=pa.int32())], names=["text", "grade"])

    return sample.select("text", toxic).mapInArrow(lean(grade), "text string, grade int")


class Scorer:
    """Margins of texts under a model; remembers what the words it has seen contribute to."""

    def __init__(self, model: Severity, remember: int = 200_000):
        self.model, self.remember = model, remember
        self.known: dict[str, tuple[str, ...]] = {}

    def margin(self, text: str | None) -> float:
        weights, known = self.model.weights, self.known
        if len(known) > self.remember:
            known.clear()
        own: dict[str, int] = {}
        for word in (text or "").lower().split():
            hit = known.get(word)
            if hit is None:
                hit = known[word] = tuple(f for f in features_of_word(word) if f in weights)
            for f in hit:
                own[f] = own.get(f, 0) + 1
        return sum(weights[f] * math.log1p(n) for f, n in own.items())


def score_severity(documents: DataFrame, model: Severity) -> DataFrame:
    """doc_id, p_toxic, expected_severity, grade (the most likely), toxic (p_toxic >= 0.5).

    One row per document, one pass without a shuffle. NULL and empty texts have no feature and get
    the prior.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            above = model.above(np.array([scorer.margin(t.as_py()) for t in batch.column(1)]))
            edge = np.concatenate(
                [np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            grade = (edge[:, :-1] - edge[:, 1:]).argmax(axis=1).astype("int64")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above[:, 0]), pa.array(above.sum(axis=1)),
                 pa.array(grade), pa.array(above[:, 0] >= 0.5)],
                names=["doc_id", "p_toxic", "expected_severity", "grade", "toxic"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lean(score), "doc_id long, p_toxic double, expected_severity double, grade long, toxic boolean")


def without_toxic(documents: DataFrame, model: Severity) -> DataFrame:
    """``documents`` without the toxic ones; all columns kept, no shuffle."""

    def test():
        scorer = Scorer(model)
        return lambda text: model.above(np.array([scorer.margin(text)]))[0, 0] < 0.5

    return rows_where(documents, test)


def severity_model(documents: DataFrame, labels: DataFrame, rows: int = 20_000) -> Severity:
    """The model of a yes/no label: sample, features, three grades, fit."""
    sample = stored(labelled_sample(documents, labels, "toxic", rows))
    features = select_features(sample)
    # stored, since a task that grades and counts holds two Python workers, which outlive it
    graded = stored(grade_by_markers(
        sample.withColumnRenamed("grade", "label"), features, "label"))
    return fit_severity(graded, features)
