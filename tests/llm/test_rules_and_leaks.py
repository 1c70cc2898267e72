import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from hindcast.llm import decontamination as dc
from hindcast.llm import quality_rules as qr
from hindcast.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1
               for k in range(3)}
    seen, dups = set(), 0
    for line in lines:
        dups += line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups,
            len(covered))


def measured(text):
    m = dict(zip(qr.MEASURES, qr.measure(text)))
    return tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                "n_repeat_words"))


@given(st.text(alphabet="ab #\n\t\x0b\x1c\x85é😀|", max_size=80))
def test_measures_equal_the_plain_definition(text):
    assert measured(text) == brute_measures(text)


def test_query_equals_the_plain_definition(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(
        f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op5_quality_rules"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def test_rules_reject_junk_and_keep_prose(make, prose):
    good = [prose(n, n) for n in (60, 200, 3000)]
    junk = [None, "", "short text", "For " * 300, prose(100, 1).replace(" ", "### "),
            prose(80, 2).upper(), " ".join("a" * 100), "\n".join(["one same line of words"] * 40)]
    rows = qr.apply_policy(qr.ledger(make(good + junk)), "web", 2).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True] * 3 + [False] * len(junk)


def test_policies_read_bits_only_and_ablations_add_up(make, prose):
    texts = [prose(10, n) for n in range(5)] + ["For " * 30, "For " * 300, prose(99, 7)]
    rows = qr.ledger(make(texts))
    kept = qr.apply_policy(rows, "base", 1).collect()
    assert sum(r["kept"] for r in kept) == 1
    got = {r["rule"]: r for r in qr.ablations(rows, "base", 1).collect()}
    assert got["too_few_words"]["fails"] == 6 and got["too_few_words"]["fails_alone"] == 5
    assert got["repeated_windows"]["fails"] == 2 and got["repeated_windows"]["fails_alone"] == 1
    assert {r["rejected"] for r in got.values()} == {7}
    none = qr.ablations(rows.filter("doc_id < 0"), "base", 1).collect()
    assert {(r["fails"], r["documents"], r["rejected"]) for r in none} == {(0, 0, 0)}


def greedy_tiles(doc, item, least):
    """Greedy string tiling as in its first description: look at all pairs of places again."""
    marked_doc, marked_item, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                       and i + n not in marked_item and d + n not in marked_doc):
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return covered
        marked_item |= set(range(i, i + n))
        marked_doc |= set(range(d, d + n))
        covered += n


@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), min_size=3,
                                                              max_size=14))
def test_tiles_cover_as_much_as_plain_greedy_tiling(doc, item):
    seeds = dc.Seeds({1: [[w.encode() for w in item]]}, 3)
    found = dc.Search(seeds, 3, 1e-9).found(" ".join(doc))
    assert sum(f[2] for f in found) == greedy_tiles(doc, item, 3)


def test_contamination_finds_passages_in_any_order(spark, make, prose):
    items = [prose(30, 1), prose(40, 2), prose(12, 3), "two words", None, "", "!!"]
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, prose(20, 9)), (0, prose(25, 4))],
                                  "item_id long, text string")
    w = items[1].split()
    turned = " ".join(w[20:] + prose(9, 8).split() + w[:20])
    texts = [
        f"{prose(50, 11)} {items[0].upper()}. {prose(50, 12)}",  # whole, in capitals
        f"{prose(20, 13)} {turned} {prose(20, 14)}",  # two halves the other way round
        f"{prose(20, 15)} {' '.join(w[:15])} {prose(20, 16)}",  # too little of it
        prose(400, 17), None, "", f"x two words y {prose(9, 18)}",
        f"{prose(9, 19)} {prose(25, 4)}", f"{items[2]} {items[0]}", f"{items[2]} {items[0]}",
    ]
    got = dc.contamination(make(texts), bench).collect()
    pairs = sorted((r["doc_id"], r["item_id"]) for r in got)
    assert pairs == [(0, 0), (1, 1), (6, 3), (7, 0), (8, 0), (8, 2), (9, 0), (9, 2)]
    assert next(r["n_tiles"] for r in got if r["doc_id"] == 1) == 2
    in_blocks = dc.contamination(make(texts), bench, block_words=1).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, got))
    clean = dc.decontaminated(make(texts), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 5]
    assert clean.columns == make(texts).columns
    assert dc.contamination(make(texts), bench.filter("item_id > 99")).count() == 0
    assert dc.contamination(make(texts).filter("doc_id < 0"), bench).count() == 0


def test_contamination_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    want = set()
    for b in bench:
        item = dc.words_of(b["text"])
        grams = {tuple(item[i:i + 5]) for i in range(len(item) - 4)}
        for d in docs:
            doc = dc.words_of(d["text"])
            starts = [i for i in range(len(doc) - 4) if tuple(doc[i:i + 5]) in grams]
            if not starts:
                continue
            near = sorted({j for i in starts for j in range(i, i + 5)})
            if greedy_tiles([doc[j] for j in near], item, 5) >= 0.5 * len(item):
                want.add((d["doc_id"], b["item_id"]))
    got = QUERIES["op7_decontamination"](spark, folder).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
