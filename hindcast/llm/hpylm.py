"""Language-model scoring by a hierarchical Pitman-Yor model.

Two levels of restaurants: one per context, whose customers are the words that follow it, and their
common parent, the unigram restaurant, whose base is uniform over the known words and one more for
all unknown ones. A context is the word before, by the first 48 bits of its hash: of n words
about n^2 / 2^49 pairs share one, at 100 million words 18. Seating follows the Chinese
restaurant process: the first customer of a dish opens a table and sends a customer to the parent,
each further one opens another with probability a / (a + k - d t), with a = (theta + d T) *
P(dish in the parent), k customers and t tables of the dish so far, T tables in the restaurant.

A cell (context, word) and all its tokens' counts are in one part. Parts are ranges of the word's
hash; the cells of a word with more than 1/``HOT_SHARE`` of a part's tokens are dealt by the hash of
the pair, so that no part depends on how frequent a word is. What a part needs of the others, the
customers and tables of its words and contexts, it gets once per round: parts send their sums to
places (ranges of the key's hash), and a place sends back what the other parts hold. No table of
words or contexts is held or broadcast whole. In a part, Gibbs sweeps take out all customers of a
cell and seat them anew given the rest, accepted by the ratio of the seating weights
(Metropolis-Hastings); the parent is sampled in between. Predictive probabilities are averaged over
the sweeps after the first.

Data flow: (1) word counts; (2) one pass that cuts documents into blocks, which keep the document of
each token and deal their cells to parts, stored there once per part; (3) rounds of seating over
these; (4) seating and scoring, one probability per cell of each block, summed per document there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import HashedWords, lean, lean_group, mixed, small_batches, stored

HOT_SHARE = 8
PART_TOKENS, BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 1_800_000, 60_000
WORD_BYTES, CONTEXT_BYTES = 8, 6
REMEMBERED = 150_000  # words whose hash a worker holds
THETA = 1.0
END = b"\x00end"
DOCS, CELLS = 0, 1
WORD, CONTEXT, PARENT = 0, 1, 2
COLUMNS = list("abcdefg")
BLOCKS = "part long, batch long, kind int, " + ", ".join(f"{c} binary" for c in COLUMNS)
SUMS = "place long, part long, kind int, a binary, b binary, c binary"
REPLIES = ("part long, place long, kind int, a binary, b binary, customers double, tables double, "
           "ones double, twos double")
PROBABILITIES = "batch long, part long, a binary, b binary, c binary, words long"
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)
ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch, their binary fields compressed; :func:`opened` undoes that."""
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    columns = list(zip(*rows)) or [[]] * len(names)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.RecordBatch.from_arrays(
        [pa.array([squeeze(x) if type(x) is bytes else x for x in c], ARROW[k])
         for c, k in zip(columns, kinds)], names=list(names))


def opened(row: dict) -> dict:
    widen = zstandard.ZstdDecompressor().decompress
    return {name: widen(x) if isinstance(x, (bytes, bytearray)) else x for name, x in row.items()}


def opened_rows(table: pa.Table) -> list[dict]:
    return [opened(row) for row in table.to_pylist()]


def apart(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: high bytes are alike and compress."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def together(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(parts.T).view(kind).ravel()


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the narrowest type that holds them all."""
    return apart(values.astype(np.min_scalar_type(int(values.max(initial=0)))))


def unpacked(data: bytes, n: int) -> np.ndarray:
    return together(data, f"u{len(data) // max(n, 1) or 1}").astype(np.int64)


def planes(keys: np.ndarray, width: int) -> bytes:
    """The first ``width`` bytes of hashes, all first bytes, then all second: sorted, these pack."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def hashes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return out.view(">u8").ravel().astype(np.uint64)


def context_of(words: np.ndarray) -> np.ndarray:
    return words & ~np.uint64(2 ** (64 - 8 * CONTEXT_BYTES) - 1)


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges of 64-bit hashes each key is in."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def parts_of(words: np.ndarray, before: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of each cell: by its word, by word and context where the word is hot."""
    part = ranges(words, parts)
    if len(hot):
        place = np.searchsorted(hot, words)
        place[place == len(hot)] = 0
        at = np.flatnonzero(hot[place] == words)
        part[at] = ranges(mixed(mixed(words[at]) ^ before[at]), parts)
    return part


def tokens_of(text: str | None, hashed: HashedWords) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, and of the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return hashed.array(words)


def _held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


# --- seating -------------------------------------------------------------------------------------

def seat(count: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator
         ) -> tuple[np.ndarray, np.ndarray]:
    """Seat the customers of every cell afresh: (tables, log weight).

    Customers up to the 48th sit down one by one; beyond, in lots of an eighth of those seated,
    within which the number of tables is held. The weight is the product of the normalisers.
    """
    order = np.argsort(-count, kind="stable")
    c, a = count[order], mass[order]
    tables = np.ones(len(c))
    weight = np.zeros(len(c))
    k, most = 1, int(c[0]) if len(c) else 0
    negative = -c
    while k < most:
        lot = 1 if k < 48 else k // 8
        live = int(np.searchsorted(negative, -k, side="left"))  # cells with more than k customers
        share = a[:live] + k - discount * tables[:live]
        n = np.minimum(c[:live] - k, lot)
        chance = np.minimum(a[:live] / share, 1.0)
        if lot == 1:
            tables[:live] += rng.random(live) < chance
        else:
            tables[:live] += rng.binomial(n.astype(np.int64), chance)
        weight[:live] += n * np.log(share)
        k += lot
    out_t, out_w = np.empty(len(c)), np.empty(len(c))
    out_t[order], out_w[order] = tables, weight
    return out_t, out_w


class Parent:
    """The unigram restaurant's totals, and its discount."""

    def __init__(self, n_words: int, customers: float, tables: float, ones: float, twos: float):
        self.customers, self.tables = customers, tables
        self.discount = _discount(ones, twos)
        self.mass = (THETA + self.discount * tables) / (n_words + 1)

    def probability(self, served: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probability of words; 0 served: unknown."""
        return (np.maximum(served - self.discount * tables, 0.0) + self.mass) / (
            THETA + self.customers)


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


class Part:
    """The cells (word, context, count) of a part and their seating; count 0: held out only."""

    def __init__(self, row: dict, step: int):
        row = opened(row)
        self.number = row["part"]
        self.words = hashes(row["a"], WORD_BYTES)
        context = hashes(row["c"], CONTEXT_BYTES)
        self.word = np.repeat(np.arange(len(self.words)), unpacked(row["b"], len(self.words)))
        self.count = unpacked(row["d"], len(context)).astype(float)
        self.contexts, self.context = np.unique(context, return_inverse=True)
        self.many = np.flatnonzero(self.count > 1)
        self.tables = np.minimum(self.count, 1.0)
        self.weight: np.ndarray | None = None
        self.root_tables = np.zeros(len(self.words))
        self.rng = np.random.default_rng([7, self.number, step])

    def of_words(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=values, minlength=len(self.words))

    def of_contexts(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=len(self.contexts))

    def sums(self, places: int) -> Iterator[tuple]:
        """Customers and tables of the part's words and contexts, for the places of these."""
        for kind, width, keys, total in (
                (WORD, WORD_BYTES, self.words, self.of_words),
                (CONTEXT, CONTEXT_BYTES, self.contexts, self.of_contexts)):
            customers, tables = total(self.count), total(self.tables)
            edges = np.searchsorted(ranges(keys, places), np.arange(places + 1))
            for place, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if a < b:
                    yield (place, self.number, kind, planes(keys[a:b], width),
                           packed(customers[a:b]), packed(tables[a:b]))

    def listen(self, replies: list[dict], places: int) -> None:
        """Take the customers of all parts and the tables of the others."""
        size = {kind: np.bincount(ranges(keys, places), minlength=places)
                for kind, keys in ((WORD, self.words), (CONTEXT, self.contexts))}
        got = {WORD: ([], []), CONTEXT: ([], [])}
        for r in sorted(replies, key=lambda r: r["place"]):
            n = int(size[r["kind"]][r["place"]])
            got[r["kind"]][0].append(unpacked(r["a"], n))
            got[r["kind"]][1].append(unpacked(r["b"], n))
        self.word_count, self.others_served = (np.concatenate(x) for x in got[WORD])
        self.customers, self.others_tables = (np.concatenate(x) for x in got[CONTEXT])

    def sweep(self, parent: Parent, discount: float) -> None:
        """Seat the parent's customers, then those of each cell with more than one."""
        served = self.others_served + self.of_words(self.tables)
        known = np.flatnonzero(served > 0)
        self.root_tables[known], _ = seat(
            served[known], np.full(len(known), parent.mass), parent.discount, self.rng)
        p = parent.probability(served, self.root_tables)
        seated = self.others_tables + self.of_contexts(self.tables)
        cells = self.many
        mass = (THETA + discount * seated[self.context[cells]]) * p[self.word[cells]]
        new, weight = seat(self.count[cells], mass, discount, self.rng)
        if self.weight is None:
            take = np.ones(len(cells), dtype=bool)
            self.weight = weight
        else:
            take = np.log(self.rng.random(len(cells))) < weight - self.weight
            self.weight = np.where(take, weight, self.weight)
        self.tables[cells[take]] = new[take]

    def averaged(self, parent: Parent, discount: float, sweeps: int, burn: int) -> np.ndarray:
        """Each cell's predictive probability, averaged over the sweeps after ``burn``."""
        total = np.zeros(len(self.word))
        for step in range(burn + sweeps):
            self.sweep(parent, discount)
            if step >= burn:
                served = self.others_served + self.of_words(self.tables)
                base = parent.probability(served, self.root_tables)
                seated = self.others_tables + self.of_contexts(self.tables)
                escape = THETA + discount * seated
                total += np.maximum(self.count - discount * self.tables, 0.0)
                total += escape[self.context] * base[self.word]
        return total / (sweeps * (THETA + self.customers[self.context]))


# --- passes over the corpus ----------------------------------------------------------------------

def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n): hash and number of every word in the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords(REMEMBERED)
        held: list[np.ndarray] = []
        size = 0

        def counted():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))],
                names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not _held_out(doc_id):
                    held.append(tokens_of(text.as_py(), hashed))
                    size += len(held[-1])
                    if size > BLOCK_TOKENS:
                        yield counted()
                        held, size = [], 0
        if held:
            yield counted()

    rows = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lean(count), "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def token_blocks(documents: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """Blocks of documents, their cells dealt to parts.

    Row DOCS: (a) ids, (b) lengths, (c) held out or not, (d) NULL ids, and, in the order of part,
    word and context, (e) tokens per cell and (f) the number in the block of each token's document.
    Rows CELLS, one per part: (a) words, (b) cells per word, (c) contexts, (d) training tokens.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords(REMEMBERED)
        first = context_of(hashed.array([END]))[0]
        number = 0
        names: list[int | None] = []
        texts: list[np.ndarray] = []
        size = 0

        def block():
            batch_id = (TaskContext.get().partitionId() << 32) + number
            length = np.array([len(t) for t in texts], dtype=np.int64)
            held = np.array([_held_out(n) for n in names])
            words = np.concatenate(texts)
            texts.clear()  # one copy of the tokens at a time, here and below
            before = np.empty(len(words), dtype=np.uint64)
            before[1:] = context_of(words[:-1])
            before[np.cumsum(length) - length] = first
            part = parts_of(words, before, hot, parts)
            order = np.lexsort((before, words, part))
            part = part[order]
            words = words[order]
            before = before[order]
            doc = np.repeat(np.arange(len(length), dtype=np.uint16), length)[order]
            del order
            starts = np.flatnonzero(np.concatenate(
                [[True], (words[1:] != words[:-1]) | (before[1:] != before[:-1])]))
            often = np.diff(np.concatenate([starts, [len(words)]]))
            train = np.add.reduceat(~held[doc], starts, dtype=np.int64)
            part = part[starts]
            words = words[starts]
            before = before[starts]
            rows = [(-1 - batch_id % 1_000_003, batch_id, DOCS,
                     np.array([n or 0 for n in names], dtype=np.int64).tobytes(),
                     length.tobytes(), held.tobytes(),
                     np.array([n is None for n in names]).tobytes(), packed(often), apart(doc),
                     None)]
            edges = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                a, b = edges[p], edges[p + 1]
                if a < b:
                    own, cells = np.unique(words[a:b], return_counts=True)
                    rows.append((p, batch_id, CELLS, planes(own, WORD_BYTES), packed(cells),
                                 planes(before[a:b], CONTEXT_BYTES), packed(train[a:b]),
                                 None, None, None))
            return _batch(rows, BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(doc_id)
                texts.append(tokens_of(text.as_py(), hashed))
                size += len(texts[-1])
                if size >= BLOCK_TOKENS or len(texts) >= BLOCK_DOCS:
                    yield block()
                    names, texts, size, number = [], [], 0, number + 1
        if texts:
            yield block()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut), BLOCKS)


def gathered(blocks: DataFrame) -> DataFrame:
    """The cells of each part, added up over blocks, as one row; rows DOCS pass through.

    (a) words, (b) cells per word, (c) contexts, (d) training tokens per cell; (e) blocks, (f) cells
    of each and (g) steps between the places of a block's cells among the part's. A block has a cell
    once, so a part is bounded by its share of the blocks' cells however frequent a word is.
    """

    def gather(table: pa.Table) -> pa.Table:
        rows = opened_rows(table)
        out = [(r["part"], r["batch"], DOCS, *(r[c] for c in COLUMNS))
               for r in rows if r["kind"] == DOCS]
        number = rows[0]["part"]
        rows = sorted((r for r in rows if r["kind"] == CELLS), key=lambda r: r["batch"])
        if rows:
            length = np.array([len(r["c"]) // CONTEXT_BYTES for r in rows], dtype=np.int64)
            words = np.concatenate([np.repeat(
                hashes(r["a"], WORD_BYTES), unpacked(r["b"], len(r["a"]) // WORD_BYTES))
                for r in rows])
            before = np.concatenate([hashes(r["c"], CONTEXT_BYTES) for r in rows])
            train = np.concatenate([unpacked(r["d"], n) for r, n in zip(rows, length)])
            batches = np.array([r["batch"] for r in rows], dtype=np.int64)
            del rows
            order = np.lexsort((before, words))
            words = words[order]
            before = before[order]
            new = np.concatenate([[True], (words[1:] != words[:-1]) | (before[1:] != before[:-1])])
            starts = np.flatnonzero(new)
            words = words[starts]
            before = before[starts]
            train = np.add.reduceat(train[order], starts)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.cumsum(new) - 1
            del order, new
            step = np.diff(place, prepend=0)
            firsts = np.cumsum(length) - length
            step[firsts] = place[firsts]
            del place
            own, cells = np.unique(words, return_counts=True)
            out.append((number, 0, CELLS, planes(own, WORD_BYTES), packed(cells),
                        planes(before, CONTEXT_BYTES), packed(train),
                        batches.tobytes(), length.tobytes(), packed(step)))
        return pa.Table.from_batches([_batch(out, BLOCKS)])

    return blocks.groupBy("part").applyInArrow(lean_group(gather), BLOCKS)


def first_sums(cells: DataFrame, places: int) -> DataFrame:
    """What parts send when each cell has one table."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _batch(list(Part(batch.slice(i, 1).to_pylist()[0], 0).sums(places)), SUMS)

    return cells.mapInArrow(lean(send), SUMS)


def met(sums: DataFrame, parent: Parent, step: int) -> DataFrame:
    """Replies of the places, and rows PARENT that add up to the parent's totals."""

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(opened_rows(table), key=lambda r: r["part"])
        out = []
        for kind, width in ((WORD, WORD_BYTES), (CONTEXT, CONTEXT_BYTES)):
            own = [r for r in rows if r["kind"] == kind]
            if not own:
                continue
            length = [len(r["a"]) // width for r in own]
            keys = np.concatenate([hashes(r["a"], width) for r in own])
            tables = np.concatenate([unpacked(r["c"], n) for r, n in zip(own, length)])
            _, at = np.unique(keys, return_inverse=True)
            customers = np.bincount(at, weights=np.concatenate(
                [unpacked(r["b"], n) for r, n in zip(own, length)]))
            total = np.bincount(at, weights=tables)
            if kind == WORD:
                served = total[total > 0]
                seated, _ = seat(served, np.full(len(served), parent.mass), parent.discount,
                                 np.random.default_rng([11, own[0]["place"], step]))
                out.append((-1, own[0]["place"], PARENT, None, None, float(served.sum()),
                            float(seated.sum()), float((served == 1).sum()),
                            float((served == 2).sum())))
            others = total[at] - tables
            end = 0
            for r, n in zip(own, length):
                a, end = end, end + n
                out.append((r["part"], r["place"], kind, packed(customers[at[a:end]]),
                            packed(others[a:end]), None, None, None, None))
        return pa.Table.from_batches([_batch(out, REPLIES)])

    return sums.groupBy("place").applyInArrow(lean_group(meet), REPLIES)


def score_documents(
    documents: DataFrame, rounds: int = 1, sweeps: int = 2, burn: int = 1,
) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out; all others train, those without
    id too. NULL and empty texts are their end alone. Repeated rows are scored (and counted) each.
    Words are known by a 64-bit hash. An empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    counts = stored(word_counts(documents))
    size = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_tokens, n_words = size["n"] or 0, size["v"]
    parts = max(24, -(-n_tokens // PART_TOKENS))
    places = max(24, parts // 4)
    # Fewer than HOT_SHARE per part by definition.
    often = counts.filter(F.col("n") * HOT_SHARE > PART_TOKENS).select("word").collect()
    hot = np.array(sorted(r["word"] % 2 ** 64 for r in often), dtype=np.uint64)
    rows = stored(gathered(token_blocks(documents, hot, parts)))
    cells = rows.filter(F.col("kind") == CELLS)

    def once_or_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = opened(batch.slice(i, 1).to_pylist()[0])
                n = unpacked(row["d"], len(row["c"]) // CONTEXT_BYTES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int((n == k).sum())], pa.int64()) for k in (1, 2)],
                    names=["ones", "twos"])

    few = cells.select("c", "d").mapInArrow(once_or_twice, "ones long, twos long").agg(
        F.sum("ones"), F.sum("twos")).first()
    discount = _discount(few[0] or 0, few[1] or 0)

    own = cells.select("part", "a", "b", "c", "d")
    parent = Parent(n_words, n_words, n_words, 0, 0)

    def exchanged(sums: DataFrame, step: int) -> tuple[DataFrame, Parent]:
        replies = stored(met(sums, parent, step))
        total = replies.filter(F.col("kind") == PARENT).agg(
            *(F.sum(c) for c in ("customers", "tables", "ones", "twos"))).first()
        return (replies.filter(F.col("kind") != PARENT).select("part", "place", "kind", "a", "b"),
                Parent(n_words, *(x or 0.0 for x in total)))

    def round_of(parent: Parent, step: int):
        def seat_part(cells: pa.Table, replies: pa.Table) -> pa.Table:
            out = []
            for row in cells.to_pylist():
                part = Part(row, step)
                part.listen(opened_rows(replies), places)
                for _ in range(2):
                    part.sweep(parent, discount)
                out += part.sums(places)
            return pa.Table.from_batches([_batch(out, SUMS)])

        return seat_part

    replies, parent = exchanged(first_sums(own, places), 0)
    for step in range(1, rounds + 2):
        sums = own.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(
            lean_group(round_of(parent, step)), SUMS)
        replies, parent = exchanged(sums, step)

    def score(cells: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in cells.to_pylist():
            part = Part(row, rounds + 2)
            row = opened({name: row[name] for name in ("part", "e", "f", "g")})
            part.listen(opened_rows(replies), places)
            logs = np.log10(part.averaged(parent, discount, sweeps, burn)).astype(np.float32)
            length = np.frombuffer(row["f"], dtype=np.int64)
            step = unpacked(row["g"], int(length.sum()))
            end = 0
            for batch, n in zip(np.frombuffer(row["e"], dtype=np.int64), length):
                a, end = end, end + n
                at = np.cumsum(step[a:end])
                word, run = np.unique(part.word[at], return_counts=True)
                out.append((int(batch), row["part"], apart(logs[at]), packed(run),
                            packed(part.word_count[word]), len(word)))
        return pa.Table.from_batches([_batch(out, PROBABILITIES)])

    probabilities = cells.select("part", *COLUMNS).groupBy("part").cogroup(
        replies.groupBy("part")).applyInArrow(lean_group(score), PROBABILITIES)
    heads = rows.filter(F.col("kind") == DOCS).select(
        "batch", F.lit(-1).cast("long").alias("part"), *COLUMNS[:6])
    both = heads.unionByName(probabilities, allowMissingColumns=True)

    def summed(table: pa.Table) -> pa.Table:
        rows = sorted(opened_rows(table), key=lambda r: r["part"])
        head, rows = rows[0], rows[1:]
        ids = np.frombuffer(head["a"], dtype=np.int64)
        doc = together(head["f"], "u2")
        score = np.concatenate([together(r["a"], "f4") for r in rows])
        count = np.concatenate([np.repeat(unpacked(r["c"], r["words"]),
                                          unpacked(r["b"], r["words"])) for r in rows])
        often = unpacked(head["e"], len(score))

        def total(values):
            return np.bincount(doc, weights=np.repeat(values, often), minlength=len(ids))

        return pa.Table.from_arrays([
            pa.array(ids, mask=np.frombuffer(head["d"], dtype=bool)),
            pa.array(np.frombuffer(head["c"], dtype=bool)),
            pa.array(np.frombuffer(head["b"], dtype=np.int64)),
            pa.array(total(count > 0).astype(np.int64)),
            pa.array(np.full(len(ids), n_tokens)),
            pa.array(total(np.log10((count + 1) / (n_tokens + n_words + 1)))),
            pa.array(total(score)),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                  "score"])

    return both.groupBy("batch").applyInArrow(lean_group(summed), SCORES)
