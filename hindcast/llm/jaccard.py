"""Jaccard self-join of texts on word shingles by chosen paths.

Each of ``RUNS`` runs splits all shingle sets: a set goes to the bucket of each of its shingles that
the run's hash picks, 1 / (threshold * size) of them, so that two similar sets are more likely than
not to share a bucket. Buckets that are too large are split again by a second pick; what is small,
or still large after that, is compared by brute force, large buckets in tiles. A pair at the
threshold with equal sizes meets in one run with probability 0.67 (0.45 when split twice), in 20
runs all but once in 10^5 times.

The brute force has two steps. Buckets hold 64-byte sketches; pairs whose sketches differ too much
to be similar (5 standard errors) are passed over. The rest form groups, and inside groups all pairs
of whole sets are compared exactly. Pairs are counted where they are found and never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import HashedWords, lean, mixed, runs, stored
from hindcast.llm.components import components

WIDTH, THRESHOLD, RUNS, LEVELS = 5, 0.8, 20, 2
SKETCH, PLAUSIBLE = 64, 35  # equal sketch bytes of a plausible pair: 0.8 * 64 - 5 * 3.2
SKETCH_LIMIT, LIMIT = 2048, 512  # sketches, and whole sets, that are compared in one piece
ODDS = mixed(np.arange(1, RUNS * LEVELS + SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None, hashed: HashedWords) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words, letters in lower case.

    A shorter text is one shingle of all its words; an empty one has none.
    """
    words = hashed.array((text or "").lower().encode("utf-8", "surrogatepass").split())
    return np.unique(runs(words, min(WIDTH, len(words)))) if len(words) else words


def picked(tokens: np.ndarray, threshold: float) -> tuple[list[int], list[int], bytes]:
    """The picks of a set, as (run and level, token), and its sketch."""
    if not len(tokens):
        return [], [], b""
    chance = min(1.0, 1.0 / (threshold * len(tokens)))
    bound = np.uint64(min(chance * 2.0 ** 64, 2.0 ** 64 - 2 ** 12))
    which, chosen = [], []
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    picks = RUNS * LEVELS
    for at in range(0, len(tokens), 4096):
        part = tokens[at:at + 4096]
        grid = part[:, None] * ODDS[None, :]
        row, column = np.nonzero(grid[:, :picks] <= bound)
        which += column.tolist()
        chosen += part[row].view(np.int64).tolist()
        np.minimum(least, grid[:, picks:].min(axis=0), out=least)
    return which, chosen, mixed(least).astype(np.uint8).tobytes()


def shingle_rows(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, text_hash, set_id, n (shingles), sketch, picks. One pass, no shuffle.

    ``set_id`` is a 64-bit hash of the set, which stands for the set from here on.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashed = HashedWords()
        for batch in batches:
            out = []
            for text in batch.column(2):
                tokens = shingles(text.as_py(), hashed)
                name = xxhash.xxh64_intdigest(tokens.tobytes()) - 2 ** 63
                out.append((name, len(tokens), *picked(tokens, threshold)))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.int64()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32())),
                 pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.binary())],
                names=["doc_id", "text_hash", "set_id", "n", "which", "chosen", "sketch"])

    source = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return source.mapInArrow(
        lean(rows), "doc_id long, text_hash long, set_id long, n long, which array<int>, "
        "chosen array<long>, sketch binary")


def _groups(
    df: DataFrame, keys: list[str], work: Callable[[dict[str, list]], dict[str, list] | None],
    schema: str,
) -> DataFrame:
    """Apply ``work`` to the rows of each group; groups are tiles, so bounded, and stream by.

    Unlike a grouped map this costs no Arrow stream per group, of which there are very many.
    """
    names = df.columns
    kinds = schema.split(", ")
    outputs = [k.split(" ")[0] for k in kinds]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64()}
        held: dict[str, list] = {n: [] for n in names}
        done: dict[str, list] = {n: [] for n in outputs}
        current = None

        def finish():
            got = work(held)
            if got:
                for n in outputs:
                    done[n] += got[n]

        def flushed():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(done[k.split(" ")[0]], types[k.split(" ")[1]]) for k in kinds],
                names=outputs)
            for n in outputs:
                done[n].clear()
            return batch

        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            for i, key in enumerate(zip(*[columns[k] for k in keys])):
                if key != current:
                    if current is not None:
                        finish()
                        for n in names:
                            held[n].clear()
                    current = key
                for n in names:
                    held[n].append(columns[n][i])
            if len(done[outputs[0]]) > 10_000:
                yield flushed()
        if current is not None:
            finish()
        yield flushed()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, "set_id")
    return dealt.mapInArrow(lean(stream), schema)


def _tiled(members: DataFrame, limit: int) -> DataFrame:
    """Deal the members of each group to tiles of about ``limit``: each pair meets in one tile.

    ``members`` has the group's size in ``size``. Groups within the limit are one tile. Larger ones
    have k parts and a tile per pair of parts; a member is in the k tiles of its own part, as is
    needed to compare all its pairs, and pairs from one part are compared in that part's tile only.
    """
    parts = F.ceil(F.col("size") / limit).cast("int")
    own = F.pmod(F.xxhash64("set_id", F.lit(1)), parts).cast("int")
    rows = members.withColumn("part", F.when(F.col("size") > limit, own).otherwise(0))
    others = F.when(F.col("size") > limit, F.sequence(F.lit(0), parts - 1)).otherwise(
        F.array(F.lit(0)))
    rows = rows.withColumn("_other", F.explode(others))
    return rows.withColumn("t1", F.least("part", "_other")).withColumn(
        "t2", F.greatest("part", "_other")).drop("_other", "size")


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest linked index of each of ``n`` members."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _in_tile(held: dict[str, list]) -> np.ndarray:
    """Which pairs of members this tile compares, as an upper triangle."""
    part = np.array(held["part"])
    mask = np.triu(np.ones((len(part), len(part)), dtype=bool), 1)
    if held["t1"][0] != held["t2"][0]:
        mask &= part[:, None] != part[None, :]
    return mask


def plausible_edges(held: dict[str, list]) -> dict[str, list] | None:
    """Edges (a, b) that span the plausible pairs of a tile, by sketches and sizes.

    A tile of two parts has only the edges that join the parts' own components, which are spanned by
    the parts' own tiles.
    """
    ids, part = held["set_id"], np.array(held["part"])
    n = len(ids)
    if n < 2:
        return None
    size = np.array(held["n"], dtype=np.float32)
    sketch = np.frombuffer(b"".join(held["sketch"]), dtype=np.uint8).reshape(n, SKETCH)
    pairs = []
    for at in range(0, n, 256):  # strips of the upper triangle
        own = slice(at, min(at + 256, n))
        equal = np.zeros((own.stop - at, n - at), dtype=np.int16)
        for k in range(SKETCH):
            equal += sketch[own, k, None] == sketch[None, at:, k]
        low = np.minimum(size[own, None], size[None, at:])
        high = np.maximum(size[own, None], size[None, at:])
        left, right = np.nonzero((equal >= PLAUSIBLE) & (low >= THRESHOLD * high - 1e-3))
        upper = left < right
        pairs.append((left[upper] + at, right[upper] + at))
    left, right = (np.concatenate(x) for x in zip(*pairs))
    root = np.arange(n)
    if held["t1"][0] != held["t2"][0]:
        inside = part[left] == part[right]
        root = _roots(n, left[inside], right[inside])
        left, right = root[left[~inside]], root[right[~inside]]
    joined = _roots(n, left, right)
    moved = np.flatnonzero((joined != np.arange(n)) & (root == np.arange(n)))
    return {"a": [ids[i] for i in moved], "b": [ids[joined[i]] for i in moved]}


def exact_links(held: dict[str, list]) -> dict[str, list] | None:
    """Links of the members of a tile: exact similarity of all pairs that the tile compares.

    A member that comes twice (a repeated document) counts once per part.
    """
    seen, take = set(), []
    for i, name in enumerate(held["set_id"]):
        if name not in seen:
            seen.add(name)
            take.append(i)
    if len(take) < 2:
        return None
    held = {k: [v[i] for i in take] for k, v in held.items()}
    ids, copies = held["set_id"], np.array(held["copies"], dtype=np.int64)
    sets = [np.frombuffer(t, dtype=np.uint64) for t in held["tokens"]]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[which] > 1
    number = np.cumsum(often > 1) - 1
    column, owner = number[which[shared]], owner[shared]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        common += block @ block.T
    union = size[:, None] + size[None, :] - common
    linked = (common >= THRESHOLD * union - 1e-9) & (union > 0) & _in_tile(held)
    left, right = np.nonzero(linked)
    if not len(left):
        return None
    root = _roots(len(ids), left, right)
    both = linked | linked.T
    sets_linked, docs_linked = both.sum(axis=1), both @ copies
    some = np.flatnonzero(sets_linked)
    return {"set_id": [ids[i] for i in some], "root": [ids[root[i]] for i in some],
            "set_links": sets_linked[some].tolist(), "doc_links": docs_linked[some].tolist()}


def _buckets(sets: DataFrame) -> DataFrame:
    """(node, set_id, size): the buckets to compare, each set of members once."""
    picks = sets.filter("n > 0").select(
        "set_id", F.explode(F.arrays_zip("which", "chosen")).alias("p")
    ).select("set_id", (F.col("p.which") % RUNS).alias("run"),
             F.floor(F.col("p.which") / RUNS).cast("int").alias("level"),
             F.col("p.chosen").alias("token"))
    picks = stored(picks)

    def sized(nodes: DataFrame) -> DataFrame:
        return nodes.groupBy("node").agg(
            F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("set_id")).alias("members"),
            F.min("set_id").alias("least"),
        ).filter("size > 1")

    def once(sizes: DataFrame) -> DataFrame:
        """Buckets with the same members are compared once."""
        return sizes.groupBy("size", "members", "least").agg(F.min("node").alias("node")).select(
            "node", "size")

    first = picks.filter("level = 0").select(
        F.xxhash64("run", "token").alias("node"), "run", "set_id")
    sizes = stored(sized(first))
    small = first.join(once(sizes.filter(F.col("size") <= SKETCH_LIMIT)), "node").select(
        "node", "set_id", "size")
    large = first.join(sizes.filter(F.col("size") > SKETCH_LIMIT).select("node"), "node")
    again = picks.filter("level = 1").select("run", "set_id", "token")
    second = stored(large.join(again, ["run", "set_id"]).select(
        F.xxhash64("node", "token").alias("node"), "set_id"))
    split = second.join(once(sized(second)), "node").select("node", "set_id", "size")
    return small.unionByName(split)


def _tokens(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, text_hash, ...) with ``tokens``, the shingles of its document's text."""
    names = [c for c in wanted.columns if c not in ("doc_id", "text_hash")]
    right = wanted.select(F.col("doc_id").alias("__near_doc"), F.col("text_hash").alias("__near_kept"), *names)
    left = documents.select(
        F.col("doc_id").cast("long").alias("__near_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__near_hash"), F.col("text").alias("_text"))
    joined = left.join(right, F.col("__near_id").eqNullSafe(F.col("__near_doc"))
                       & (F.col("__near_hash") == F.col("__near_kept"))).select("_text", *names)
    kinds = dict(joined.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords()
        for batch in batches:
            tokens = [shingles(t.as_py(), hashed).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(tokens, pa.binary())], names=[*names, "tokens"])

    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    return joined.mapInArrow(lean(cut), f"{schema}, tokens binary")


def set_classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (doc_id, text_hash, set_id), and per set its class and links.

    The second has set_id, copies, rep (the document that stands for the set: smallest doc_id, NULL
    last), root (the class), set_links and doc_links (sets and documents linked to the set).
    """
    rows = stored(shingle_rows(documents))
    sets = stored(rows.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"),
        F.first("n").alias("n"), F.first("which").alias("which"),
        F.first("chosen").alias("chosen"), F.first("sketch").alias("sketch")))
    buckets = _buckets(sets)
    # Of a tile's rows only the sketch is needed; it joins after the tiles are dealt to few rows.
    tiles = _tiled(buckets, SKETCH_LIMIT).join(sets.select("set_id", "n", "sketch"), "set_id")
    edges = _groups(tiles.select("node", "t1", "t2", "part", "set_id", "n", "sketch"),
                    ["node", "t1", "t2"], plausible_edges, "a long, b long")
    groups = components(edges).withColumnRenamed("node", "set_id").withColumnRenamed("root", "grp")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    members = groups.join(sizes, "grp").join(
        sets.select("set_id", "copies", "rep.doc_id", "rep.text_hash"), "set_id")
    whole = _tokens(documents, members)
    dealt = _tiled(whole, LIMIT).select("grp", "t1", "t2", "part", "set_id", "copies", "tokens")
    links = stored(_groups(dealt, ["grp", "t1", "t2"], exact_links,
                           "set_id long, root long, set_links long, doc_links long"))
    roots = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("set_id").agg(
        F.sum("set_links").alias("set_links"), F.sum("doc_links").alias("doc_links"))
    classes = sets.select("set_id", "copies", "rep").join(
        counts, "set_id", "left").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    return rows.select("doc_id", "text_hash", "set_id"), classes.select(
        "set_id", "copies", "rep", F.coalesce("root", "set_id").alias("root"),
        F.coalesce("set_links", F.lit(0)).alias("set_links"),
        F.coalesce("doc_links", F.lit(0)).alias("doc_links"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, n_text_links.

    Documents are linked when the Jaccard similarity of their sets of five-word shingles is at
    least 0.8; texts with equal sets are copies of each other, empty and NULL texts too. Classes
    are the connected components, named by their smallest doc_id (NULL if none has an id).
    ``n_links`` counts linked documents, copies included, ``n_text_links`` linked different sets.
    Repeated rows are copies.
    """
    rows, classes = set_classes(documents)
    named = classes.groupBy("root").agg(
        F.min("rep.doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    facts = classes.join(named, "root").select(
        "set_id", "class_id", "class_size",
        (F.col("doc_links") + F.col("copies") - 1).alias("n_links"),
        F.col("set_links").alias("n_text_links"))
    return rows.select("doc_id", "set_id").join(facts, "set_id").select(
        "doc_id", "class_id", "class_size", "n_links", "n_text_links")


def one_per_class(documents: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each class; all columns kept."""
    _, classes = set_classes(documents)
    kept = classes.groupBy("root").agg(F.min("rep").alias("rep")).select(
        F.col("rep.doc_id").alias("__near_doc"), F.col("rep.text_hash").alias("__near_kept"))
    keyed = documents.withColumn("__near_id", F.col("doc_id").cast("long")).withColumn(
        "__near_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    chosen = keyed.join(kept, F.col("__near_id").eqNullSafe(F.col("__near_doc"))
                        & (F.col("__near_hash") == F.col("__near_kept")), "left_semi")
    return chosen.dropDuplicates(["__near_id", "__near_hash"]).select(*documents.columns)
