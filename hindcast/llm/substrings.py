"""Substring dedup by content-defined chunks.

A gear rolling hash over the UTF-8 bytes sets chunk borders by content, so chunks of a repeated
passage come out alike wherever it stands and insertions shift no later border. Chunks are compared
by 128-bit digest; chunks that several documents hold, side by side, make a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import mixed, stored

# One pseudo-random 16-bit number per byte value.
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
NO_ID = -(2 ** 63)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash (h << 1) + GEAR[byte] at every byte, 16 bits wide, so 16 bytes deep.

    Summed by doubling: a window of 2, 4, 8, 16 bytes is two windows of half the width.
    """
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h = longer
    return h


def chunk_ends(data: bytes, average: int = 24, least: int = 16, most: int = 512) -> list[int]:
    """Ends of the chunks of ``data``: behind a byte whose hash is small, where a character begins.

    No chunk but the last is shorter than ``least``; one longer than ``most`` is cut at the next
    character. ``average`` is the mean distance from ``least`` on.
    """
    n = len(data)
    if n == 0:
        return []
    view = np.frombuffer(data, dtype=np.uint8)
    small = gear_hashes(view) < np.uint16(65536 // average)
    begins = np.ones(n, dtype=bool)
    begins[:-1] = (view[1:] & 0xC0) != 0x80
    out, start = [], 0
    for end in (np.flatnonzero(small & begins) + 1).tolist():
        while end - start > most:
            cut = start + most
            while not begins[cut - 1]:
                cut += 1
            if cut >= end:
                break
            out.append(cut)
            start = cut
        if end - start >= least:
            out.append(end)
            start = end
    while n - start > most:
        cut = start + most
        while cut < n and not begins[cut - 1]:
            cut += 1
        out.append(cut)
        start = cut
    if start < n:
        out.append(n)
    return out


def chunks(documents: DataFrame, **sizes) -> DataFrame:
    """(doc, begin, end, hi, lo): all chunks of all texts with their digests; offsets in bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 500):
                docs, counts, begins, ends, digests = [], [], [], [], []
                for doc, text in zip(doc_ids[at:at + 500], batch.column(1).slice(at, 500)):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    own = chunk_ends(data, **sizes)
                    starts = [0, *own[:-1]] if own else []
                    docs.append(doc)
                    counts.append(len(own))
                    begins += starts
                    ends += own
                    digests += [digest(data[a:b]) for a, b in zip(starts, own)]
                both = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(docs, dtype=np.int64), counts)),
                     pa.array(begins, pa.int32()), pa.array(ends, pa.int32()),
                     pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64))],
                    names=["doc", "begin", "end", "hi", "lo"])

    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    return rows.mapInArrow(cut, "doc long, begin int, end int, hi long, lo long")


def repeated_spans(documents: DataFrame, least_bytes: int = 120, **sizes) -> DataFrame:
    """Passages that stand in several documents: one row per passage and document.

    doc_id; begin, end (bytes of the UTF-8 text); n_chunks; first_doc_id, the smallest id among the
    documents that hold its chunks; ``repeated`` is false in that document, where the passage stays,
    true where it repeats an earlier document. Passages shorter than ``least_bytes`` are left out. A
    passage of 50 words loses at most a chunk at either side, as borders fall into line behind its
    first bytes. Repeats within one document alone do not count. All rows without doc_id are one
    document, whose id is NULL; empty texts have no chunks.

    Digests are reduced before the shuffle; the join back is on the digest, which Spark splits when
    one chunk stands in a large part of all documents.
    """
    table = stored(chunks(documents, **sizes))
    shared = table.groupBy("hi", "lo").agg(
        F.min("doc").alias("first"), F.max("doc").alias("_last")
    ).filter("first < _last").drop("_last")
    hits = table.join(shared, ["hi", "lo"]).groupBy("doc", "begin", "end").agg(
        F.min("first").alias("first"))
    order = Window.partitionBy("doc").orderBy("begin", "end")
    gap = F.col("begin") != F.coalesce(F.lag("end").over(order), F.lit(-1))
    turned = (F.col("first") == F.col("doc")) != F.coalesce(
        F.lag(F.col("first") == F.col("doc")).over(order), F.lit(False))
    hits = hits.withColumn("_new", (gap | turned).cast("int"))
    hits = hits.withColumn("_span", F.sum("_new").over(order))
    spans = hits.groupBy("doc", "_span").agg(
        F.min("begin").cast("long").alias("begin"), F.max("end").cast("long").alias("end"),
        F.count(F.lit(1)).alias("n_chunks"), F.min("first").alias("first"),
    )

    def named(column: str):
        return F.when(F.col(column) != NO_ID, F.col(column))

    # A passage may go over from "first here" to "repeated": its length counts as a whole.
    whole = Window.partitionBy("doc").orderBy("begin")
    spans = spans.withColumn("_run", F.sum(
        (F.col("begin") != F.coalesce(F.lag("end").over(whole), F.lit(-1))).cast("int")
    ).over(whole))
    length = F.sum(F.col("end") - F.col("begin")).over(Window.partitionBy("doc", "_run"))
    return spans.withColumn("_length", length).filter(F.col("_length") >= least_bytes).select(
        named("doc").alias("doc_id"), "begin", "end", "n_chunks",
        named("first").alias("first_doc_id"), (F.col("first") != F.col("doc")).alias("repeated"))


def without_repeats(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` with the repeated passages cut out of their texts; all columns kept."""
    columns = documents.columns
    at = columns.index("text")
    cuts = spans.filter("repeated").groupBy(F.col("doc_id").alias("__cut_doc")).agg(
        F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("__cuts"))  # one text's spans

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(len(columns)).to_pylist()):
                if spans and texts[i]:
                    data, last, parts = texts[i].encode("utf-8", "surrogatepass"), 0, []
                    for span in spans:
                        parts.append(data[last:span["begin"]])
                        last = span["end"]
                    texts[i] = b"".join([*parts, data[last:]]).decode("utf-8", "surrogatepass")
            kept = list(batch.columns[:len(columns)])
            kept[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(kept, names=columns)

    joined = documents.join(cuts, documents["doc_id"].eqNullSafe(cuts["__cut_doc"]), "left")
    return joined.drop("__cut_doc").mapInArrow(cut, documents.schema)
