import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hindcast.llm import importance

SEPARATORS = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SEPARATORS.split(lower) if w]


def features_of(text, widths):
    w = words_of(text)
    return [" ".join(w[i:i + k]) for k in range(1, widths + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, buckets, widths, percent, least_words):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s = Counter(bucket(f) for _, text in docs for f in features_of(text, widths))
    t = Counter(bucket(f) for text in target for f in features_of(text, widths))
    total, aim = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets)
                                            / ((s[b] + 1) * (aim + buckets))))
                 for b in map(bucket, features_of(text, widths))]
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(gains), weight, weight + noise, None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= least_words),
                  key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, row in enumerate(able[:len(able) * percent // 100]):
        row[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_crcs_of_all_runs_follow_from_prefixes():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abÀ中9") for _ in range(rng.choice((1, 3, 70, 5000))))
                    for _ in range(60)).encode()
    crcs, lengths = importance.prefix_crcs(text)
    w = text.split()
    for width in (1, 2, 3, 7):
        want = [zlib.crc32(b" ".join(w[i:i + width])) for i in range(len(w) - width + 1)]
        assert importance.gram_crcs(crcs, lengths, width).tolist() == want
    assert len(importance.gram_crcs(crcs, lengths, 61)) == 0
    assert importance.prefix_crcs(None)[0].size == importance.prefix_crcs(b" ,\x00")[0].size == 0


def test_shifts_of_any_length():
    lengths = np.array([0, 1, 63, 64, 65, 4095, 4096, 300_000])
    got = importance.shifted(np.full(len(lengths), 0xDEADBEEF, np.uint32), lengths)
    for n, value in zip(lengths, got):
        data = b"x" * int(n)  # crc(A + B) = shift(crc(A)) ^ crc(B)
        assert int(value) == zlib.crc32(data, 0xDEADBEEF) ^ zlib.crc32(data)


@pytest.mark.parametrize("widths", [1, 3])
def test_draw_equals_the_plain_definition(spark, make, prose, widths):
    docs = [(i, prose(3 + i)) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "Ça VA, ça-va! 中文 x y\x00z"), (None, prose(30)),
             (63, docs[40][1]), (63, docs[40][1]), (64, "a" * 70_000 + " " + prose(40))]
    target = [docs[50][1], docs[51][1], None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = importance.resample(make(docs), items, buckets=500, widths=widths, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, 500, widths, 30, 20)


def test_empty_tables(spark, make):
    empty = spark.createDataFrame([], "item_id int, text string")
    assert importance.resample(make([]), empty).collect() == []
    [row] = importance.resample(make(["some words"]), empty, least_words=1, percent=100).collect()
    assert row["rank"] == 1 and row["n_features"] == 2
