"""Benchmark decontamination by greedy string tiling.

Benchmark items are cut into runs of ``least`` words (seeds). Documents are searched for seeds in
one pass without a shuffle; a document that shares seeds with an item is tiled against it: the
longest match of words unmarked on both sides is marked, again and again, matches being found by
hashes of word runs that grow from the seeds (running Karp-Rabin) and compared word by word. An
item whose words are covered to ``threshold`` contaminates the document, in whatever order its
passages stand.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import HashedWords, lean, rows_where, runs

MARKS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
RESULT = ("doc_id long, item_id long, item_words long, covered_words long, n_tiles long, "
          "coverage double")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII marks separate like spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(MARKS).split()


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], least: int
          ) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in document, start in item, words), longest first.

    ``seeds`` are the pairs of places whose next ``least`` words agree. Ties go to the earliest
    place in the item, then in the document. Marked words never match again.
    """
    free_doc = np.ones(len(doc), dtype=bool)
    free_item = np.ones(len(item), dtype=bool)
    found = []
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for d, i in seeds:
        by_diagonal[d - i].append(i)
    # Maximal matches: on one diagonal, seeds that follow each other word by word join.
    matches = []
    for shift, places in by_diagonal.items():
        places.sort()
        start = last = places[0]
        for p in places[1:]:
            if p > last + 1:
                matches.append((shift, start, last + least))
                start = p
            last = p
        matches.append((shift, start, last + least))
    while matches:
        pieces = []
        for shift, a, b in matches:  # cut to what both sides have left
            free = free_item[a:b] & free_doc[a + shift:b + shift]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            pieces += [(shift, a + s, a + e) for s, e in zip(edge[::2], edge[1::2])
                       if e - s >= least]
        if not pieces:
            break
        longest = max(e - s for _, s, e in pieces)
        for shift, s, e in sorted(pieces, key=lambda p: (p[1], p[1] + p[0])):
            if (e - s == longest and free_item[s:e].all()
                    and free_doc[s + shift:e + shift].all()):
                free_item[s:e] = False
                free_doc[s + shift:e + shift] = False
                found.append((int(s + shift), int(s), int(e - s)))
        matches = pieces
    return found


def item_blocks(benchmark: DataFrame, block_words: int = 2_000_000) -> Iterator[dict]:
    """The benchmark in blocks of bounded size: {item_id: words}. Rows stream to the driver."""
    block, size = {}, 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for row in rows.toLocalIterator():
        if row["item_id"] is None:
            continue
        words = words_of(row["text"])
        block.setdefault(row["item_id"], []).append(words)
        size += len(words)
        if size >= block_words:
            yield block
            block, size = {}, 0
    if block:
        yield block


def contamination(
    documents: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5,
    block_words: int = 2_000_000,
) -> DataFrame:
    """Pairs (doc_id, item_id) whose tiles cover at least ``threshold`` of the item's words.

    The benchmark is the query set and is read in blocks of at most about ``block_words`` words;
    each block is broadcast and meets all documents. A document row is never joined with all items,
    only with those whose seeds it holds. Items of fewer than ``least`` words count as covered when
    the document holds all their words in a row; items without a word, and rows without item_id,
    match nothing. Repeated rows give repeated pairs; NULL doc_id is kept.
    """
    parts = [
        _against(documents, block, least, threshold)
        for block in item_blocks(benchmark, block_words)
    ]
    if not parts:
        return documents.sparkSession.createDataFrame([], RESULT)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5,
    block_words: int = 2_000_000,
) -> DataFrame:
    """``documents`` without the rows that an item contaminates; all columns kept, no shuffle."""
    out = documents
    for block in item_blocks(benchmark, block_words):
        shared = documents.sparkSession.sparkContext.broadcast(Seeds(block, least))

        def test(shared=shared):
            search = Search(shared.value, least, threshold)
            return lambda text: not search.found(text)

        out = rows_where(out, test)
    return out


class Seeds:
    """A block of items: their word hashes, and where each run of ``least`` words stands."""

    def __init__(self, block: dict[int, list[list[bytes]]], least: int):
        hashed = HashedWords()
        self.items: list[tuple[int, np.ndarray]] = []
        self.places: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for item_id in sorted(block):
            for words in block[item_id]:
                ids = hashed.array(words)
                if not len(ids):
                    continue
                width = min(least, len(ids))
                for place, h in enumerate(runs(ids, width)):
                    self.places[width, int(h)].append((len(self.items), place))
                self.items.append((item_id, ids))
        self.by_width = {
            w: np.array(sorted(h for v, h in self.places if v == w), dtype=np.uint64)
            for w in sorted({w for w, _ in self.places})
        }


class Search:
    """Finds the items of a block that a text contains."""

    def __init__(self, seeds: Seeds, least: int, threshold: float):
        self.seeds, self.least, self.threshold = seeds, least, threshold
        self.hashed = HashedWords()

    def found(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, words of the item, words covered, tiles) of each item at the threshold."""
        seeds, out = self.seeds, []
        ids = self.hashed.array(words_of(text))
        pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for width, wanted in seeds.by_width.items():
            hashes = runs(ids, width)
            near = np.searchsorted(wanted, hashes)
            near[near == len(wanted)] = 0
            for d in np.flatnonzero(wanted[near] == hashes):
                for item, place in seeds.places[width, int(hashes[d])]:
                    if (ids[d:d + width] == seeds.items[item][1][place:place + width]).all():
                        pairs[item].append((int(d), place))
        for item, places in pairs.items():
            item_id, words = seeds.items[item]
            least = min(self.least, len(words))
            if self.threshold * len(words) > least * len(places):
                continue  # even disjoint matches could not cover enough
            got = tiles(ids, words, places, least)
            covered = sum(n for _, _, n in got)
            if covered >= self.threshold * len(words):
                out.append((item_id, len(words), covered, len(got)))
        return out


def _against(documents: DataFrame, block: dict, least: int, threshold: float) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(Seeds(block, least))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, least, threshold)
        for batch in batches:
            rows = [
                (doc_id, item, n, covered, count, covered / n)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                for item, n, covered, count in search.found(text.as_py())
            ]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, kinds)],
                names=["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "coverage"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(pairs), RESULT)
