"""Spelling variants of the words of a corpus, grouped under their most frequent form.

Two words are near if one code point is inserted, deleted or replaced. Cut in two, one of them then
shares a whole half with the other: so words are dealt by either half, and every shard searches its
words in a bidirectional FM-index of its own, matching the shared half exactly and extending across
the other with one error (:mod:`hindcast.llm.fm_index`). A half that very many words share is no hot
spot: the region that may hold the error is halved again, and the words are dealt by what is left.

NULL texts have no words and a NULL id is written as nothing. Repeated rows count as often as they
stand there. Ties go to the smaller word in code-point order. A run of letters may be of any length.
Empty tables give empty results; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import stored
from hindcast.llm.fm_index import Index, one_error

# Runs of A-Z, a-z and U+00C0..U+00FF, whose UTF-8 form is 0xC3 and one more byte.
_OTHER_SCRIPT = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_LETTER_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))
HELD_WORDS = 100_000  # distinct words a task adds up before it sends them
SHARD_ROWS = 40_000
# Words of one shard that share what is matched exactly; more, and the error's region is halved.
# A region of one code point holds at most 90 + 90 * 90 words, so halving ends below this.
GROUP_ROWS = 10_000


def words_of(text: bytes, doc_id: int | None, least: int) -> list[bytes]:
    """Lowered runs with ``least`` code points or more, some of them with the marked one deleted."""
    if not text.isascii():
        text = _OTHER_SCRIPT.sub(b" ", text)
    runs = [w for w in text.translate(_LETTER_BYTES).split() if len(w) >= least]
    seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for i in [i for i, w in enumerate(runs) if zlib.crc32(w, seed) % 31 == 0]:
        h, run = zlib.crc32(runs[i], seed), runs[i].decode()
        at = h % len(run)
        runs[i] = (run[:at] + run[at + 1:]).encode()
    return runs


def word_counts(documents: DataFrame, least: int = 7, least_count: int = 2) -> DataFrame:
    """``word, n`` of all whole texts. Tasks add up before the shuffle, so no word is hot."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            # the prefilter is by bytes; a letter beyond ASCII has two
            found = [w for w in held if len(w) - w.count(b"\xc3") >= least]
            numbers = pa.array([held[w] for w in found], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), numbers],
                                              names=["word", "n"])

        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.update(words_of(text.as_py() or b"", doc_id.as_py(), least))
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return (
        rows.mapInArrow(counted, "word binary, n long")
        .groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least_count)
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """Add the hash of what must match exactly: the parts beside the region, and the region."""
    longer = F.length("word") - F.col("shorter")
    return rows.withColumn("key", F.xxhash64(
        "shorter", "low", "high", F.expr("substring(word, 1, low)"),
        F.substring("word", F.col("high") + longer + 1, F.length("word"))))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")),
                     F.struct(middle.alias("low"), F.col("high")))
    return _dealt(rows.withColumn("_half", F.explode(halves)).select(
        "word", "n", "shorter", F.col("_half.low").alias("low"), F.col("_half.high").alias("high")))


def error_regions(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``word, n, shorter, low, high, key``: where a word may differ from another.

    A word meets those of its own length and of one more as the shorter word (``shorter`` is its
    length), those of one less as the longer one. Places count from 0 in the shorter word.
    """
    length = F.length("word")
    both = words.withColumn("shorter", F.explode(F.array(length, length - 1)))
    whole = both.withColumns({"low": F.lit(0), "high": F.col("shorter")})
    rows = _halved(whole)
    while True:
        sizes = rows.filter("high - low > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        hot = stored(sizes.filter(F.col("size") > group_rows).select("key"))
        if hot.isEmpty():
            return rows
        wide = rows.join(hot, "key", "left_semi").filter("high - low > 1")
        rest = rows.join(hot, "key", "left_anti").unionByName(
            rows.join(hot, "key", "left_semi").filter("high - low <= 1"))
        rows = rest.unionByName(_halved(wide))


def _search(words: list[str], counts: np.ndarray, shorter: np.ndarray, low: np.ndarray,
            high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Near pairs among the rows of one shard, each direction once per index."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    high = high + lengths - shorter  # in the word's own places
    from_left = low > lengths - high  # the exact part is longer on the left
    for side in (False, True):
        rows = np.flatnonzero(from_left == side)
        if not len(rows):
            continue
        turned = [words[i][::-1] if side else words[i] for i in rows]
        a, b, m = low[rows], high[rows], lengths[rows]
        if side:
            a, b = m - b, m - a
        index = Index(turned)
        number = np.zeros(len(index.words), np.int64)
        place = np.searchsorted(np.array(index.words, object), np.array(turned, object))
        number[place] = counts[rows]
        pattern, found = one_error(index, turned, a, b, m > shorter[rows])
        pairs = np.unique(place[pattern] * len(index.words) + found)
        pattern, found = pairs // len(index.words), pairs % len(index.words)
        listed = pa.array([w[::-1] for w in index.words] if side else index.words, pa.string())
        yield pa.RecordBatch.from_arrays(
            [listed.take(pa.array(pattern)), listed.take(pa.array(found)), pa.array(number[found])],
            names=["word", "near", "near_n"])


def near_words(words: DataFrame, group_rows: int = GROUP_ROWS,
               shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``word, near, near_n``: all pairs that differ by one code point, in both directions, once."""
    rows = error_regions(words, group_rows)
    shards = max(1, -(-rows.count() // shard_rows))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one shard: bounded by the two sizes above
        if not held:
            return
        shard = pa.Table.from_batches(held)
        word, n, shorter, low, high = (shard.column(i) for i in range(5))
        yield from _search(word.to_pylist(), *(c.to_numpy().astype(np.int64)
                                               for c in (n, shorter, low, high)))

    dealt = rows.repartition(shards, "key").drop("key")
    pairs = dealt.mapInArrow(searched, "word string, near string, near_n long")
    return pairs.dropDuplicates(["word", "near"])


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form. Each round doubles the steps; n rises tenfold a step,
    so there are few."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if reached.join(further, "root", "left_semi").isEmpty():
            return reached
        reached = stored(reached.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root")))


def spelling_variants(documents: DataFrame, least: int = 7, least_count: int = 2,
                      times: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root``: one row per word.

    ``form`` is the near word of largest n if that is ``times`` the word's own n or more, else NULL.
    ``root`` is the last word that forms lead to, the word itself without a form.
    """
    words = stored(word_counts(documents, least, least_count))
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("negative"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.negative") >= F.col("n") * times
    grouped = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.negative")).alias("form_n")))
    roots = _roots(grouped.filter("form is not null"))
    return grouped.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
