"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

The documents of a source form a stream in a seeded order, cut into blocks of equally many words.
Blocks (seats) go to sources by highest quotients target / (2 * seats + 1); shard after shard takes
its equal share of the seats, so the seats between two house sizes are a shard's whole quotas. A
source's draws walk over its blocks from a seeded first block and start over behind the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import word_count


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2
) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): its ``target`` in words.

    Sources by code point, NULL last, weigh ``weights`` in turn and share ``share`` times all words.
    A target stops at ``most`` times its source's size; the excess goes to the others by weight
    until none is above. In order of size / weight the stopped sources come first, so one pass over
    that order finds the final level. The windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1)
    rows = sizes.select("source", "source_size", weight.cast("long").alias("weight"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "weight",
                           F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * most
    everything = Window.partitionBy(F.lit(1))
    rows = rows.select(
        "*", cap.alias("cap"), F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(everything)
         - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        (F.sum("source_size").over(everything) * share).alias("total"),
        F.row_number().over(order).alias("place"),
    )
    # The share of a source if all before it are stopped and none from it on.
    fair = (F.col("total") - F.col("cap_before")) * F.col("weight") / F.col("weight_left")
    rows = rows.withColumn("open", F.col("cap").cast("double") >= fair)
    first_open = F.min(F.when(F.col("open"), F.col("place"))).over(everything)
    first = F.col("place") == first_open
    level_words = F.max(F.when(first, F.col("total") - F.col("cap_before"))).over(everything)
    level_weight = F.max(F.when(first, F.col("weight_left"))).over(everything)
    target = F.when(
        F.col("place") >= first_open, level_words * F.col("weight") / level_weight
    ).otherwise(F.col("cap").cast("double"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def shard_quotas(targets: DataFrame, shards: int = 16, block_words: int = 64) -> DataFrame:
    """Per source: ``upto``, its seats after each shard (index 0: none), by Sainte-Lague.

    With H seats given out so far, a divisor slightly too large gives every source seats it surely
    has and one slightly too small seats it may have; only the few in between, at most three per
    source, are ranked by quotient (ties: the source that comes first). No list of all seats is
    made, so the cost depends on sources and shards, not on words. A source never gets more seats
    than its target's stop has blocks.
    """
    sources = Window.partitionBy(F.lit(1))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = targets.select(
        "*", F.row_number().over(by_name).alias("place"), F.count(F.lit(1)).over(sources).alias("n"),
        F.sum("target").over(sources).alias("all"),
        (F.ceil(F.col("source_size") / block_words) * 2).alias("stop"),
    )
    seats = F.round(F.col("all") / block_words).cast("long")
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = rows.withColumn("house", F.floor(seats * (F.col("shard") + 1) / shards).cast("long"))

    def rounded(house):
        return F.when(
            (house > 0) & (F.col("all") > 0), F.floor(F.col("target") * house / F.col("all") + 0.5)
        ).otherwise(F.lit(0)).cast("long")

    rows = rows.select("*", rounded(F.col("house") - F.col("n")).alias("sure"),
                       (rounded(F.col("house") + F.col("n")) + 1).alias("most"))
    per_house = Window.partitionBy("shard")
    rows = rows.withColumn("left", F.col("house") - F.sum("sure").over(per_house))
    tried = rows.filter("most > sure and target > 0").withColumn(
        "seat", F.explode(F.expr("sequence(sure, most - 1)"))
    )
    quotient = F.col("target") / (2 * F.col("seat") + 1)
    ranked = tried.withColumn(
        "rank", F.row_number().over(Window.partitionBy("shard").orderBy(
            quotient.desc(), "place", "seat"))
    ).groupBy("shard", "place").agg(
        F.sum((F.col("rank") <= F.col("left")).cast("long")).alias("won")
    )
    given = rows.join(ranked, ["shard", "place"], "left").select(
        "place", "source", "source_size", "weight", "target", "shard",
        F.least(F.col("sure") + F.coalesce("won", F.lit(0)), "stop").alias("seats"),
    )
    listed = F.sort_array(F.collect_list(F.struct("shard", "seats")))  # one entry per shard
    return given.groupBy("place", "source", "source_size", "weight", "target").agg(
        F.concat(F.array(F.lit(0).cast("long")), listed["seats"]).alias("upto")
    )


def _blocks(size, block_words: int):
    return F.ceil(size / block_words).cast("long")


def _covered(draws, block_words: int):
    """Words of a document at [begin, begin + size) of its stream within the first ``draws``."""
    n = _blocks(F.col("source_size"), block_words)
    rest = draws % n
    first = F.col("first_block")

    def overlap(low, high):
        words = F.least(F.col("begin") + F.col("size"), high * block_words)
        return F.greatest(words - F.greatest(F.col("begin"), low * block_words), F.lit(0))

    part = overlap(first, F.least(first + rest, n)) + overlap(
        F.lit(0), F.greatest(first + rest - n, F.lit(0)))
    return F.when(n > 0, F.floor(draws / n) * F.col("size") + part).otherwise(F.lit(0)).cast("long")


def mix(
    documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
    shards: int = 16, block_words: int = 64, seed: int = 7, keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Per document the words the mix takes, in all (``taken``) and by shard (``shard_words``).

    Running totals per source are made in two levels: a seeded digest of id and text names a
    document's bin (4096 per source), bins are summed first, and documents are ordered within their
    bin only, so a source with a third of all rows spreads over all tasks. Rows equal in id, size
    and text may swap places, which leaves the result as it is. Documents without a word take 0, a
    NULL text has none; NULL is a source like any other. An empty table gives no rows.
    """
    size = word_count("text")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"),
                               F.md5(F.coalesce("text", F.lit("")))))
    rows = documents.select(*keep, "source", size.alias("size"), digest.alias("digest"))
    rows = rows.withColumn("bin", F.substring("digest", 1, 3))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    quotas = shard_quotas(source_targets(sizes, weights, share), shards, block_words)
    n = _blocks(F.col("source_size"), block_words)
    first = F.pmod(
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"first {seed}"), "source")), 1, 8), 16, 10)
        .cast("long"), F.greatest(n, F.lit(1)))
    quotas = quotas.withColumn("first_block", first)
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("source", "bin",
                       F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("bin_begin"))
    placed = bins.alias("b").join(quotas.alias("q"), F.col("b.source").eqNullSafe(F.col("q.source")))
    placed = placed.select(F.col("b.source").alias("_source"), F.col("bin").alias("_bin"),
                           "bin_begin", "source_size", "target", "upto", "first_block")
    within = Window.partitionBy("source", "bin").orderBy(
        "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_bin", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(placed, F.col("source").eqNullSafe(F.col("_source"))
                     & (F.col("bin") == F.col("_bin")))
    rows = rows.withColumn("begin", F.col("bin_begin") + F.col("in_bin"))
    by_shard = F.transform(F.col("upto"), lambda draws: _covered(draws, block_words))
    rows = rows.withColumn("covered", by_shard)
    return rows.select(
        *keep, "source", "size", "source_size", "target",
        F.element_at("covered", -1).alias("taken"),
        F.transform(F.sequence(F.lit(1), F.lit(shards)),
                    lambda k: F.element_at("covered", k + 1) - F.element_at("covered", k)
                    ).alias("shard_words"),
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents as the mix repeats them: rounded to whole documents, all columns kept."""
    columns = documents.columns
    whole = documents.withColumn("_row", F.struct(*columns))
    rows = mix(whole, keep=("doc_id", "_row"), **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(
        F.lit(0)).cast("int")
    copied = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return copied.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
