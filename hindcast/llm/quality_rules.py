"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one failure bit
per rule; a policy is a named, versioned set of rules whose bits reject a document, so policies can
be changed, compared and ablated without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words",
            "n_shouting", "n_distinct_words")
# A rule fails where its condition holds; its place in the list is its bit.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines and n_dup_lines >= 3"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("shouting", "2 * n_shouting > n_words"),
    ("few_distinct_words", "n_words >= 50 and 20 * n_distinct_words < n_words and "
                           "n_distinct_words < 50"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
POLICIES = {
    ("base", 1): ("too_few_words", "repeated_windows"),
    ("web", 1): tuple(name for name, _ in RULES if name != "few_distinct_words"),
    ("web", 2): tuple(name for name, _ in RULES),
}


def policy_mask(name: str, version: int) -> int:
    return sum(BIT[rule] for rule in POLICIES[name, version])


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``. NULL is the empty text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly the six ASCII white spaces
    n = len(words)
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [line for line in data.split(b"\n") if line.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n > 3:
        size = len(number)
        pairs = ids[:-2] * size + ids[1:-1]
        if size < 2_000_000:
            windows = pairs * size + ids[2:]
        else:  # numbers would not fit: number the pairs first
            windows = np.unique(pairs, return_inverse=True)[1] * size + ids[2:]
        _, which, often = np.unique(windows, return_inverse=True, return_counts=True)
        twice = often[which] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k:n - 2 + k] |= twice
        repeated = int(covered.sum())
    shouting = sum(1 for w in words if len(w) > 3 and w.isupper())
    return (n, len(text) - spaces, sum(text.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)), len(lines), repeated, shouting, len(number))


def ledger(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the measurements, and ``fail_bits``. One pass, no shuffle."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(text.as_py()) for text in batch.column(1)]
            values = np.array(rows, dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(values[:, i]) for i in range(len(MEASURES))]],
                names=["doc_id", *MEASURES])

    measures = ", ".join(f"{m} long" for m in MEASURES)
    rows = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        measured, f"doc_id long, {measures}")
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(0).cast("long"))
    return rows.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, name: str, version: int) -> DataFrame:
    """``kept``: no bit of the policy is set. Works on any ledger, without texts."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(policy_mask(name, version)) == 0)


def ablations(rows: DataFrame, name: str, version: int) -> DataFrame:
    """Per rule of a policy: documents it fails, fails alone, and would come back without it.

    One aggregation over the bits; its size depends on the number of rules only.
    """
    mask = policy_mask(name, version)
    failed = F.col("fail_bits").bitwiseAND(mask)
    counts = [F.count(F.lit(1)).alias("documents"),
              F.sum((failed != 0).cast("long")).alias("rejected")]
    for rule in POLICIES[name, version]:
        counts.append(F.sum((failed.bitwiseAND(BIT[rule]) != 0).cast("long")).alias(f"f_{rule}"))
        counts.append(F.sum((failed == BIT[rule]).cast("long")).alias(f"a_{rule}"))
    one = rows.agg(*counts)
    listed = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.coalesce(f"f_{rule}", F.lit(0)).alias("fails"),
                 F.coalesce(f"a_{rule}", F.lit(0)).alias("fails_alone"))
        for rule in POLICIES[name, version]
    ])
    return one.select("documents", F.coalesce("rejected", F.lit(0)).alias("rejected"),
                      F.explode(listed).alias("r")).select("r.*", "documents", "rejected")
