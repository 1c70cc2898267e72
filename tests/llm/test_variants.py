import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hindcast.llm import variants
from hindcast.llm.fm_index import Index, one_error

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counts_of(docs, least=7, least_count=2):
    seen = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= least_count}


def brute(counts, times=10):
    rows = {}
    for word, n in counts.items():
        others = [o for o in counts if abs(len(o) - len(word)) < 2 and near(word, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        rows[word] = [n, len(others), form, counts[form] if form else None]
    out = []
    for word, row in rows.items():
        root = word
        while rows[root][2] is not None:
            root = rows[root][2]
        out.append((word, *row, root))
    return sorted(out)


def made_words(rng, letters, n, least, most):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
                   for _ in range(n)})


@pytest.mark.parametrize("letters, n", [("ab", 150), ("abcé", 500), ("aÿ", 60), ("abcdefgh", 900)])
def test_index_finds_all_words_one_error_away(letters, n):
    rng = random.Random(n)
    words = made_words(rng, letters, n, 3, 9) + ["a" * 40, "a" * 41, "a" * 39 + "b"]
    words = sorted(set(words))
    index = Index(words)
    assert index.words == words
    lengths = np.array([len(w) for w in words])
    zero = np.zeros(len(words), int)
    found = set()
    for loses in (False, True):
        p, f = one_error(index, words, zero, lengths, np.full(len(words), loses))
        found |= {(words[a], words[b]) for a, b in zip(p, f)}
    assert found == {(a, b) for a, b in itertools.permutations(words, 2) if near(a, b)}


def test_index_keeps_to_the_region_of_the_error():
    words = ["abcdefg", "abcxefg", "xbcdefg", "abcdefx", "abcdefgh", "abcefg", "zabcdefg"]
    index, pattern = Index(words), ["abcdefg"]

    def hits(low, high, loses):
        _, f = one_error(index, pattern, np.array([low]), np.array([high]), np.array([loses]))
        return {index.words[i] for i in f}

    assert hits(2, 5, False) == {"abcxefg"} and hits(2, 5, True) == {"abcefg"}
    assert hits(0, 3, False) == {"xbcdefg", "zabcdefg"} and hits(4, 7, True) == set()
    assert hits(5, 7, False) == {"abcdefx", "abcdefgh"}


@pytest.mark.parametrize("group_rows", [10_000, 20])
def test_near_words_with_and_without_crowded_halves(spark, group_rows):
    rng = random.Random(4)
    words = made_words(rng, "abc", 300, 7, 9) + made_words(rng, "àbcdexyz", 200, 7, 12)
    words += ["prefixed" + w for w in made_words(rng, "ab", 80, 4, 6)] + ["q" * 3000, "q" * 3001]
    words = sorted(set(words))
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = variants.near_words(table, group_rows, shard_rows=300).collect()
    want = {(a, b) for a, b in itertools.permutations(words, 2)
            if abs(len(a) - len(b)) < 2 and near(a, b)}
    assert len(got) == len(want) and {(r["word"], r["near"]) for r in got} == want


def test_crowded_halves_are_split(spark):
    rng = random.Random(5)
    words = sorted({"longprefix" + "".join(rng.choice("abcdef") for _ in range(8)) for _ in range(900)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    sizes = variants.error_regions(table, 50).groupBy("key").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 50
    assert variants.error_regions(table, 50).count() < 40 * len(words)


def test_variants_equal_the_plain_definition(spark, make, prose):
    rng = random.Random(6)
    base = made_words(rng, "aeinrstlé", 60, 7, 11)
    docs = []
    for i in range(220):
        text = " ".join(rng.choice(base[:6]) if rng.random() < .8 else rng.choice(base)
                        for _ in range(60))
        docs.append((i * 7, text.replace(" ", rng.choice((" ", ", ", "-", "中", " × ", "\n")))))
    chain = [("variante", 400), ("variant", 30), ("varian", 0), ("varianz", 3), ("variants", 2)]
    docs.append((5, " ".join(w for w, n in chain for _ in range(n)).upper()))
    docs += [(None, "Éclairage éclairage ÉCLAIRAGE"), (8, None), (9, ""), (10, "x" * 50_000), (11, "12 _ 34"),
             (docs[3][0], docs[3][1])]
    got = variants.spelling_variants(make(docs))
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == brute(counts_of(docs))
    assert sum(r[3] is not None for r in rows) > 20


def test_forms_lead_to_the_last_word(spark):
    steps = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("other", "w9"), ("alone", "x")]
    table = spark.createDataFrame(steps, "word string, form string")
    got = {r["word"]: r["root"] for r in variants._roots(table).collect()}
    assert got == {**{f"w{i}": "w9" for i in range(9)}, "other": "w9", "alone": "x"}


def test_empty_table(make):
    assert variants.spelling_variants(make([])).collect() == []
    assert variants.spelling_variants(make(["short words"])).collect() == []
