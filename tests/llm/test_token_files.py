import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hindcast.llm import token_files as tf
from hindcast.operators.reliable import scratch_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [
    "", None, " ", "a", "  two  spaces ", "tabs\tand\n\nlines\n ", "x\x1cy z", "é ü ñ  x",
    "it's we'll  they'RE", "<|endoftext|> in a text", "emoji 😀 tail", "12 345,6.7 !!!", "word " * 5000,
    "q" * 3000, "a\r\nb \x0b c", "﻿bom", "same", "same",
]


@given(st.lists(st.integers(0, 2 ** 17 - 1), max_size=60), st.integers(17, 32), st.data())
def test_packing_is_exact_and_any_range_can_be_read(ids, bits, data):
    packed = tf.pack(np.array(ids, dtype=np.uint32), bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert tf.unpack(packed, bits, a, b).tolist() == ids[a:b]


@pytest.mark.parametrize("vocabulary, bits", [(1, 1), (2, 1), (256, 8), (257, 9), (50257, 16)])
def test_width(vocabulary, bits):
    assert tf.bits_for(vocabulary) == bits


@given(st.lists(st.text(max_size=40), max_size=5))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    coder = tf.encoder(PATH)
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [a.tolist() for a in coder.texts(texts)] == want


def brute(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def written(spark, df, **options):
    folder = scratch_folder(df)
    tf.write_token_file(df, folder, PATH, **options)
    return folder, tf.read_token_file(spark, folder)


def test_round_trip_of_odd_texts(spark, make):
    folder, got = written(spark, make(ODD_TEXTS), block_ids=64)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == brute(enumerate(ODD_TEXTS))
    want = Tokenizer.from_file(PATH).encode(ODD_TEXTS[8], add_special_tokens=False).ids + [0]
    assert tf.read_ids(spark, folder, 8) == [want]


def test_null_and_repeated_ids_and_no_rows(spark, make):
    rows = [(5, "b"), (None, "n"), (5, "a"), (5, "a"), (1, None)]
    _, got = written(spark, make(rows))
    got = [tuple(r) for r in got.orderBy("start").collect()]
    assert [r[0] for r in got] == [None, 1, 5, 5, 5]
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    _, none = written(spark, make([(1, "x")]).filter("doc_id < 0"))
    assert none.count() == 0


def test_query_equals_direct_encoding(spark):
    from hindcast.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id")
    want = brute((r["doc_id"], r["text"]) for r in texts.collect())
    got = QUERIES["op1_token_files"](spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == want
