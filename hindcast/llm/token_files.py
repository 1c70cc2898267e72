"""Token ids in fixed-width bit-packed blocks.

A token file is a folder of Parquet rows, one per block: its shard, its number in the shard, the
position of its first id in the shard, the bit width, the packed ids, and for each of its documents
the id and the position behind its last token in the block. A block closes with the first document
that brings it to ``block_ids`` ids, so each block can be read alone. Any id range inside a block
is found by bit offset; see ``unpack``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.llm.common import lean

BLOCKS = (
    "shard int, block int, start long, n_ids long, bits int, packed binary, "
    "doc_ids array<long>, doc_ends array<long>"
)
# Pieces start where white space follows something else, and where an ASCII mark (but for the
# apostrophe) follows a Latin letter. The tokenizer's own split never joins two such pieces, so ids
# of a text are the ids of its pieces in order.
SPACE = r"[^\S\x1c-\x1f]"
MARK = r"!-&(-/:-@\[-`{-~"
PIECE = re.compile(
    rf"{SPACE}*+(?:[^\s{MARK}]++(?:(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[{MARK}])|[\S\x1c-\x1f]*+)"
    rf"|[\S\x1c-\x1f]++)|{SPACE}+\Z")

BLANK_FIRST = re.compile(rf"{SPACE}.*[\S\x1c-\x1f]", re.DOTALL)
JOINED = 64  # pieces joined to one text for the tokenizer, which gets as many texts in a call


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits``-wide big-endian numbers, back to back, last byte filled with zeros."""
    ids = np.asarray(ids, dtype=np.uint32)
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits:].reshape(-1)).tobytes()


def unpack(packed: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """Ids number ``first`` to ``last`` (excluded) of a block; touches only their bytes."""
    if bits in (8, 16, 32):
        part = np.frombuffer(packed, dtype=f">u{bits // 8}", count=last - first,
                             offset=first * bits // 8) if last > first else np.empty(0)
        return part.astype(np.uint32)
    begin, end = first * bits, last * bits
    part = np.frombuffer(packed, dtype=np.uint8)[begin // 8:(end + 7) // 8]
    flat = np.unpackbits(part)[begin % 8:begin % 8 + end - begin].reshape(-1, bits)
    wide = np.zeros((len(flat), 32), dtype=np.uint8)
    wide[:, 32 - bits:] = flat
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


REMEMBERED = 400_000  # pieces in either half of an encoder's memory, about 200 bytes each


class Encoder:
    """The tokenizer with a bounded memory of pieces it has seen, as packed ids.

    The memory has two halves: when the newer one is full it becomes the older one, and pieces that
    come again move back, so that rare pieces are forgotten first.
    """

    def __init__(self, path: str, remember: int = REMEMBERED, longest: int = 64):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a byte-level token has one character per byte
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remember, self.longest = remember, longest

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Packed ids of pieces. Those that begin with white space and end with something else are
        pieces of their joined text too, so the tokenizer gets many of them as one text. It is not
        asked for offsets, which cost more than the ids: bytes tell where a piece's ids end."""
        joins = BLANK_FIRST.fullmatch
        joined = list(filter(joins, new))
        apart = [] if len(joined) == len(new) else [p for p in new if not joins(p)]
        parts = [joined[at:at + JOINED] for at in range(0, len(joined), JOINED)]
        for at in range(0, len(parts), JOINED):
            some = parts[at:at + JOINED]
            for part, got in zip(some, self.tokenizer.encode_batch_fast(
                    list(map("".join, some)), add_special_tokens=False)):
                ids = np.array(got.ids, dtype=np.uint32)
                behind = np.cumsum(self.n_bytes[ids])
                ends = np.cumsum([len(p.encode()) for p in part])
                last = np.searchsorted(behind, ends)
                if len(behind) != last[-1] + 1 or (behind[last] != ends).any():
                    apart += part  # a tokenizer that drops bytes, or joins over a piece's end
                    continue
                packed, last = ids.tobytes(), (4 * (last + 1)).tolist()
                for piece, a, b in zip(part, [0, *last], last):
                    yield piece, packed[a:b]
        for at in range(0, len(apart), 4096):
            part = apart[at:at + 4096]
            for piece, got in zip(part, self.tokenizer.encode_batch_fast(
                    part, add_special_tokens=False)):
                yield piece, array("I", got.ids).tobytes()

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; equal to encoding each text whole."""
        pieces = [None if any(s in t for s in self.specials) else PIECE.findall(t) for t in texts]
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        every = list(chain.from_iterable(own for own in pieces if own))
        packed = list(map(known.get, every))  # the one lookup of most pieces
        unknown = [i for i, ids in enumerate(packed) if ids is None]
        new = []
        for piece in dict.fromkeys(every[i] for i in unknown):
            if (ids := older.get(piece)) is not None:
                known[piece] = ids
            else:
                new.append(piece)
        known.update(self._pieces(new))
        for i in unknown:
            packed[i] = known[every[i]]
        for piece in new:
            if len(piece) > self.longest:
                del known[piece]
        out, at = [], 0
        for text, own in zip(texts, pieces):
            if own is None:
                out.append(np.array(self.whole(text), dtype=np.uint32))
                continue
            out.append(np.frombuffer(b"".join(packed[at:at + len(own)]), dtype=np.uint32))
            at += len(own)
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remember: int = REMEMBERED) -> Encoder:
    """One encoder per Python worker, so that tasks share what it remembers."""
    if (path, remember) not in _ENCODERS:
        _ENCODERS[path, remember] = Encoder(path, remember)
    return _ENCODERS[path, remember]


def write_token_file(
    documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0,
    block_ids: int = 65_536, remember: int = REMEMBERED, keep: bool = True,
) -> None:
    """Tokenize ``documents`` (doc_id, text) and write them in ascending ``doc_id`` order.

    Rows are range partitioned by (doc_id, text), so a repeated doc_id cannot fill one task unless
    its rows are equal; each partition is one shard. NULL doc_id comes first, rows of one doc_id
    are ordered by text. A NULL or empty text is its end id alone. An empty table gives no blocks.
    ``remember`` trades a worker's memory for time; without ``keep`` pieces are forgotten when a task
    ends, so that its worker holds none of them in later stages.
    """
    ordered = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text"
    )

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, remember)
        end = np.array([end_id], dtype=np.uint32)
        bits = bits_for(coder.tokenizer.get_vocab_size(with_added_tokens=True))
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held, names, ends, size = [], [], [], 0

        def closed():
            row = [[shard], [block], [start], [size], [bits], [pack(np.concatenate(held), bits)],
                   [names], [ends]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, type=t) for v, t in zip(row, TYPES)], names=NAMES
            )

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(at, 512).to_pylist()
                for doc_id, ids in zip(doc_ids[at:at + 512], coder.texts(texts)):
                    held += (ids, end)
                    size += len(ids) + 1
                    names.append(doc_id)
                    ends.append(size)
                    if size >= block_ids:
                        yield closed()
                        block, start = block + 1, start + size
                        held, names, ends, size = [], [], [], 0
        if held:
            yield closed()
        if not keep:
            coder.forget()

    ordered.mapInArrow(lean(pack_blocks), BLOCKS).write.parquet(folder)


NAMES = ["shard", "block", "start", "n_ids", "bits", "packed", "doc_ids", "doc_ends"]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(),
         pa.list_(pa.int64()), pa.list_(pa.int64())]


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with ``base``, the number of ids in all shards before theirs.

    The shard table has one row per writing task, so the window and the broadcast are bounded by
    the number of partitions of the writing job.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return blocks.join(F.broadcast(bases), "shard")


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and ids_bytes, from the packed blocks."""
    import zlib

    def unpack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["packed"], row["bits"], 0, row["n_ids"]).astype("<u4")
                begins = [0, *row["doc_ends"][:-1]]
                spans = list(zip(begins, row["doc_ends"]))
                first = row["base"] + row["start"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], type=pa.int64()),
                    pa.array([first + a for a, _ in spans], type=pa.int64()),
                    pa.array([b - a for a, b in spans], type=pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], type=pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCKS).parquet(folder)
    return _placed(blocks).mapInArrow(
        lean(unpack_documents), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_ids(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with one ``doc_id``; only their blocks' bytes are unpacked."""
    rows = spark.read.schema(BLOCKS).parquet(folder).filter(F.array_contains("doc_ids", doc_id))
    found = []
    for row in rows.toLocalIterator():
        begins = [0, *row["doc_ends"][:-1]]
        for name, a, b in zip(row["doc_ids"], begins, row["doc_ends"]):
            if name == doc_id:
                found.append(unpack(row["packed"], row["bits"], a, b).tolist())
    return found
