"""Importance resampling towards a target distribution, over hashed n-grams.

Each separator-normalised document is scanned once. The scan keeps the running CRC-32 at the end of
every word; the CRC of any n-gram then follows from two of these prefixes: the earlier one, shifted
by the length of the n-gram (a multiplication by a power of x in GF(2)), cancels what stands before
it. Texts are not read again, whatever widths of n-grams are asked for.

NULL texts have no words. Documents without words weigh 0. Repeated rows are rows of their own and
are drawn as such; NULL ids come after all others among equal scores. Empty tables give empty
results, columns other than doc_id and text are not looked at. A word may be of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import stored
from hindcast.operators.ordering import global_row_number

# Digits, letters and everything beyond ASCII make words, of which A-Z are lowered.
_KEPT = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_WORD_BYTES = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b in set(_KEPT) else 0x20 for b in range(256))
_BYTES = np.arange(256, dtype=np.uint32)


def _byte_table() -> np.ndarray:
    table = _BYTES.copy()
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


TABLE = _byte_table()


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as one table of 256 images per byte."""
    out = tables[0][values & 255]
    for k in (1, 2, 3):
        out = out ^ tables[k][(values >> np.uint32(8 * k)) & 255]
    return out


@cache
def _shift_level(level: int) -> np.ndarray:
    """Tables of the shifts by 0..64 times 64 ** level zero bytes."""
    if level == 0:
        images = np.stack([_BYTES << np.uint32(8 * k) for k in range(4)])
        one = TABLE[images & 255] ^ (images >> np.uint32(8))
    else:
        one = _shift_level(level - 1)[64]
    steps = [np.stack([_BYTES << np.uint32(8 * k) for k in range(4)])]
    for _ in range(64):
        steps.append(_apply(one, steps[-1]))
    return np.stack(steps)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs moved past ``lengths`` further bytes, whose own part is left out."""
    level, left = 0, lengths
    while True:
        digit, tables = left & 63, _shift_level(level)
        out = tables[digit, 0, crcs & 255]
        for k in (1, 2, 3):
            out = out ^ tables[digit, k, (crcs >> np.uint32(8 * k)) & 255]
        crcs, left, level = out, left >> 6, level + 1
        if not left.any():
            return crcs


def prefix_crcs(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Running CRC at the end of each word, of the words with one space before each; word lengths."""
    words = (text or b"").translate(_WORD_BYTES).split()
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    crc, crcs, step = 0, [], zlib.crc32
    for word in (b" " + b"\x00 ".join(words)).split(b"\x00"):
        crc = step(word, crc)
        crcs.append(crc)
    return np.array(crcs, np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def gram_crcs(crcs: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """CRC-32 of every run of ``width`` words joined by one space, from the prefixes alone."""
    n = len(crcs) - width + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    before = ~np.concatenate([np.zeros(1, np.uint32), crcs[:n - 1]])
    before = ~(TABLE[(before ^ 0x20) & 255] ^ (before >> np.uint32(8)))  # past the space
    ends = np.cumsum(lengths + 1)
    sizes = ends[width - 1:] - (ends - lengths - 1)[:n] - 1
    return crcs[width - 1:] ^ shifted(before, sizes)


def scan(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, crcs, lengths``: the stored scan; 4 bytes a word, and 1 (4 if a word is that long)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, lengths = [], []
            for text in batch.column(1):
                c, n = prefix_crcs(text.as_py())
                narrow = not len(n) or int(n.max()) < 256
                crcs.append(c.astype("<u4").tobytes())
                lengths.append(n.astype(np.uint8 if narrow else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(crcs, pa.binary()), pa.array(lengths, pa.binary())],
                names=[key, "crcs", "lengths"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(key, F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(scanned, f"{key} {kind}, crcs binary, lengths binary"))


def _grams(batch: pa.RecordBatch, widths: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of a scan: number of words, CRCs of all runs of 1 to ``widths`` words."""
    for crcs, lengths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        c = np.frombuffer(crcs, "<u4")
        n = np.frombuffer(lengths, np.uint8 if len(lengths) == len(c) else "<u4").astype(np.int64)
        yield len(c), np.concatenate([gram_crcs(c, n, w) for w in range(1, widths + 1)])


def bucket_counts(scans: DataFrame, buckets: int, widths: int) -> DataFrame:
    """``bucket, n``: features of all documents. A task sends each bucket once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, grams in _grams(batch, widths):
                total += np.bincount(grams % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return scans.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Per bucket floor(1000 ln) of its smoothed share in the target over that in the source.

    The array has ``buckets`` numbers whatever the tables hold, so it may go to the driver.
    """
    spark = source.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = (
        every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .na.fill(0, ["s", "t"]).collect()
    )
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in counts:
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    share = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weights(scans: DataFrame, gains: np.ndarray, widths: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains of a document."""
    buckets = np.uint32(len(gains))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, grams in _grams(batch, widths):
                n = len(grams)
                rows.append((words, n, int(gains[grams % buckets].sum()) // n if n else 0))
            values = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(values[:, i]) for i in range(3)]],
                names=["doc_id", "n_words", "n_features", "weight"])

    kind = scans.schema["doc_id"].dataType.simpleString()
    return scans.mapInArrow(
        weighed, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(
    documents: DataFrame, target: DataFrame, buckets: int = 10_000, widths: int = 1,
    percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: Gumbel top-k draw of ``percent`` of the documents.

    ``score`` is the weight and a noise that depends on seed and id alone; the ``rank`` of those not
    drawn is NULL. Only documents of ``least_words`` words may be drawn and count towards the draw.
    """
    scans = scan(documents)
    marked = target.select(F.lit(0).alias("item"), "text")
    gains = bucket_gains(bucket_counts(scans, buckets, widths),
                         bucket_counts(scan(marked, "item"), buckets, widths), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
                    256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stored(weights(scans, gains, widths).withColumn(
        "score", (F.col("weight") + noise).cast("long")))
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    order = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    numbered = global_row_number(scored, order, "_number")
    return numbered.select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("_number") <= drawn, F.col("_number")).cast("long").alias("rank"))
