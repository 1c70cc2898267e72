import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hindcast.llm import jaccard, substrings
from hindcast.llm.common import HashedWords
from hindcast.llm.components import components
from hindcast.llm.queries import QUERIES


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else \
        frozenset()


def brute(rows):
    """doc position -> (class, class size, linked documents, linked different sets)."""
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = sets[i], sets[j]
            if i != j and (a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))):
                link[i][j] = True
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    members = defaultdict(list)
    for i in range(n):
        members[root[i]].append(i)
    out = []
    for i in range(n):
        own = members[root[i]]
        ids = [rows[k][0] for k in own if rows[k][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(own), sum(link[i]),
                    len({sets[j] for j in range(n) if link[i][j] and sets[j] != sets[i]})))
    return sorted(out, key=str)


def altered(text, n, seed):
    rng, words = random.Random(seed), text.split()
    for k in range(n):
        words[rng.randrange(len(words))] = f"new{seed}_{k}"
    return " ".join(words)


def corpus(prose):
    base = [prose(n, n) for n in (6, 30, 80, 150, 400)]
    texts = list(base)
    for i, text in enumerate(base):
        texts += [altered(text, k, 10 * i + k) for k in range(0, 5)]
    line = prose(12, 77)
    texts += [f"{prose(30, 200 + k)} {line} {prose(30, 300 + k)}" for k in range(12)]
    texts += [None, "", " ", "one two", "one two", "One TWO", prose(9000, 5), prose(9000, 5) + " x"]
    return texts


def got(df):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str)


def test_classes_and_links_equal_brute_force(make, prose):
    texts = corpus(prose)
    assert got(make(texts)) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids(make, prose):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(3, a), (3, a), (None, a), (None, b), (None, b), (9, altered(a, 1, 4)), (9, b + " z")]
    assert got(make(rows)) == brute(rows)
    kept = jaccard.one_per_class(make(rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, a), (9, b + " z")]
    assert got(make(rows).filter("doc_id < 0")) == []


def test_groups_larger_than_a_tile(make, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", 7)
    monkeypatch.setattr(jaccard, "SKETCH_LIMIT", 9)
    base = prose(100, 3)
    texts = [altered(base, 1, k) for k in range(40)] + [base] * 5 + [prose(50, k) for k in range(9)]
    assert got(make(texts)) == brute(list(enumerate(texts)))


def test_one_document_of_each_class_stays(make, prose):
    texts = corpus(prose)
    kept = jaccard.one_per_class(make(texts))
    want = {c for _, c, *_ in brute(list(enumerate(texts)))}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert kept.columns == make(texts).columns


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(
        f"{folder}/documents.parquet").collect()]
    df = QUERIES["op6_jaccard_join"](spark, folder)
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)


def test_similar_sets_meet_in_a_run(prose):
    """Recall of the runs alone at the threshold, without the exact step."""
    hashed, met, pairs = HashedWords(), 0, 0
    for seed in range(60):
        a = prose(200, seed)
        b = altered(a, 4, seed)
        x, y = shingle_set(a), shingle_set(b)
        if len(x & y) < 0.8 * len(x | y):
            continue
        pairs += 1
        one, two = (set(zip(*jaccard.picked(jaccard.shingles(t, hashed), 0.8)[:2]))
                    for t in (a, b))
        met += any(level < jaccard.RUNS for level, _ in one & two)
    assert pairs > 20 and met == pairs


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(k, k + 1) for k in range(400, 460)] + [(500, 500)]
    root = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    want = {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert components(df.filter("a < 0")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=900), st.integers(4, 40), st.integers(0, 30))
def test_chunks_are_whole_and_begin_at_characters(text, average, least):
    data = text.encode()
    ends = substrings.chunk_ends(data, average, least, 100)
    assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends))
    for a, b in zip([0, *ends], ends):
        data[a:b].decode()
        assert b - a <= 103


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(1).randbytes(400), dtype=np.uint8)
    h, want = 0, []
    for byte in data:
        h = ((h << 1) + int(substrings.GEAR[byte])) % 2 ** 16
        want.append(h)
    assert substrings.gear_hashes(data).tolist() == want


def test_chunks_resist_insertions(prose):
    text = prose(2000, 4).encode()

    def cut(data):
        ends = substrings.chunk_ends(data)
        return {data[a:b] for a, b in zip([0, *ends], ends)}

    assert len(cut(text) & cut(text[:700] + b"inserted" + text[700:])) > 0.95 * len(cut(text))


def test_repeated_passages_are_found_and_clean_documents_left_alone(make, prose):
    passages = [prose(51, 1000 + k) for k in range(40)]
    texts, want = [], {}
    for k, passage in enumerate(passages):
        for copy in range(2):
            want[len(texts)] = 2 * k
            texts.append(f"{prose(60, 5000 + 2 * k + copy)} {passage} {prose(60, 9000 + 2 * k + copy)}")
    clean = len(texts)
    texts += [prose(300, 20_000 + k) for k in range(40)]
    texts += [None, "", "short", "short", prose(20_000, 7)]
    df = make(texts)
    rows = substrings.repeated_spans(df).collect()
    assert {r["doc_id"] for r in rows if r["doc_id"] < clean} == set(want)
    assert not [r for r in rows if r["doc_id"] >= clean]
    for r in rows:
        assert r["first_doc_id"] == want[r["doc_id"]]
        assert r["repeated"] == (r["doc_id"] != r["first_doc_id"])
        got = texts[r["doc_id"]].encode()[r["begin"]:r["end"]].decode()
        assert got in texts[r["first_doc_id"]]
    cut = substrings.without_repeats(df, substrings.repeated_spans(df))
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert left[clean] == texts[clean] and left[0] == texts[0] and left[clean + 40] is None
    assert len(left[1]) < len(texts[1]) and cut.columns == df.columns


def test_spans_of_null_ids_repeats_and_no_rows(make, prose):
    a = prose(100, 1)
    rows = [(None, a), (None, a), (4, a), (4, a), (5, prose(100, 2) + " " + a)]
    spans = substrings.repeated_spans(make(rows)).collect()
    assert {r["doc_id"] for r in spans} == {None, 4, 5}
    assert {r["first_doc_id"] for r in spans} == {None}
    assert substrings.repeated_spans(make(rows).filter("doc_id < 0")).count() == 0
    one = substrings.repeated_spans(make([(4, a), (4, a)]))  # the same document twice
    assert one.count() == 0


@pytest.mark.parametrize("name", ["op3_substring_dedup"])
def test_substring_query_against_whole_digests(spark, name):
    """Each span's text stands in another document; each whole copy of a long text is covered."""
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(
        f"{folder}/documents.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    first = {}
    for doc_id in sorted(texts):
        first.setdefault(texts[doc_id], doc_id)
    covered = {(r["doc_id"], r["end"] - r["begin"]) for r in rows if r["repeated"]}
    for doc_id, text in texts.items():
        size = len(text.encode())
        if first[text] != doc_id and size > 200:
            assert sum(n for d, n in covered if d == doc_id) >= 0.9 * size
