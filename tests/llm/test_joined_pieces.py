"""New pieces of text go to the tokenizer many at a time and keep their ids."""

from __future__ import annotations

import random

import numpy as np
import pytest

from hindcast.llm import token_files

TEXTS = [
    "plain words, a comma; don't  stop\n\n two blanks  and a tail \n", "", " ", "é à ü　字 文字",
    "a-b c_d 12-3 4,5 x=y #tag \x1c odd \x1f ones\x1d", "naïve Ünïcode 😀😀 family 👩‍👧 ok", " lead\t\ttab\r\n",
]


@pytest.fixture(scope="module")
def coder():
    tokenizers = pytest.importorskip("public_tokenizers")
    return token_files.Encoder(tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_whole_texts(coder):
    rng = random.Random(5)
    marks = [" ", "  ", "\n", " ", "é", "字", "😀", "-", ",", "'s", "\x1c", "ab", "7", "_", "Zz"]
    made = ["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(2000)]
    texts = TEXTS + made
    for text, ids in zip(texts, coder.texts(texts)):
        assert ids.tolist() == coder.whole(text), repr(text)


def test_few_calls_for_many_new_pieces(coder, monkeypatch):
    class Counting:
        calls = 0

        def encode(self, *args, **kwargs):
            Counting.calls += 1
            return real.encode(*args, **kwargs)

        def encode_batch_fast(self, texts, **kwargs):
            Counting.calls += len(texts)
            return real.encode_batch_fast(texts, **kwargs)

    real = coder.tokenizer
    monkeypatch.setattr(coder, "tokenizer", Counting())
    words = " ".join(f"w{i}" for i in range(1000))
    (ids,) = coder.texts([words])
    assert Counting.calls < 20
    assert np.array_equal(ids, real.encode(words, add_special_tokens=False).ids)
