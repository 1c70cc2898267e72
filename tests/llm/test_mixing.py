import re

import pytest

from hindcast.llm import mixing
from hindcast.llm.queries import ORACLES, QUERIES
from workloads.compare import compare

PYTHON = ("Python", "Pandas", "Arrow")


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql_without_python(spark, folder):
    df = QUERIES["op9_mixing"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [p for p in PYTHON if p in plan] == []
    assert "CartesianProduct" not in plan
    assert compare(lambda *_: df, ORACLES["op9_mixing"], spark, folder) == ""


def targets_by_rounds(sizes, weights=(3, 1, 2)):
    """The rule as it is told: share, stop, share the excess again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        free = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped |= {s: 2.0 * sizes[s] for s in over}


def seats_by_quotients(targets, house):
    seats = {s: 0 for s in targets}
    for _ in range(house):
        s = max(targets, key=lambda s: targets[s] / (2 * seats[s] + 1))
        seats[s] += 1
    return seats


SIZES = {"a": 900, "b": 40, "é": 700, "Z": 10_000, None: 333, "tiny": 1, "none": 0}


def sizes_frame(spark, sizes=SIZES):
    return spark.createDataFrame(list(sizes.items()), "source string, source_size long")


def test_targets_equal_resharing_in_rounds(spark):
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes_frame(spark)).collect()}
    want = targets_by_rounds(SIZES)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])
        assert got[s] <= 2 * SIZES[s] + 1e-9


def test_quotas_equal_seats_given_one_by_one(spark):
    targets = mixing.source_targets(sizes_frame(spark))
    by_source = {r["source"]: r["target"] for r in sorted(
        targets.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        if r["target"] > 0}  # ties go to the source that comes first
    rows = mixing.shard_quotas(targets, shards=5, block_words=16).collect()
    house = int(sum(by_source.values()) / 16 + 0.5)
    for shard in range(6):
        want = seats_by_quotients(by_source, house * shard // 5)
        for r in rows:
            stop = 2 * -(-SIZES[r["source"]] // 16)
            assert r["upto"][shard] == min(want.get(r["source"], 0), stop), (shard, r)


def test_taken_words_reach_the_targets(spark, make, prose):
    texts = [prose(n % 97, n) for n in range(600)] + [None, "", "   "]
    df = make(texts)
    rows = mixing.mix(df, block_words=8).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: r["size"] for r in rows} == {
        i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert all(sum(r["shard_words"]) == r["taken"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 16
    again = mixing.mix(df.repartition(7), block_words=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_shards_get_equal_shares(spark, make, prose):
    rows = mixing.mix(make([prose(80, n) for n in range(300)]), block_words=8, shards=4).collect()
    sums = [sum(r["shard_words"][k] for r in rows) for k in range(4)]
    assert max(sums) - min(sums) <= 8 * 4


def test_documents_are_repeated_or_left_out_whole(spark, make, prose):
    df = make([prose(50, n) for n in range(90)] + [None])
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in mixing.mix(df).collect():
        want = int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
        assert copies.get(r["doc_id"], 0) == want


def test_no_rows_and_no_words(spark, make):
    assert mixing.mix(make([(1, "x")]).filter("doc_id < 0")).count() == 0
    rows = mixing.mix(make([None, "", " "])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 3


def test_null_source_and_repeated_rows(spark):
    df = spark.createDataFrame(
        [(1, "a b c", None), (1, "a b c", None), (None, "d e", "s")],
        "doc_id long, text string, source string")
    rows = mixing.mix(df, block_words=1).collect()
    assert len(rows) == 3
    assert {r["source"]: r["source_size"] for r in rows} == {None: 6, "s": 2}
