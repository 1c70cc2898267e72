"""New pieces are cut apart by the bytes of their tokens, without asking the tokenizer for offsets."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa

from hindcast.llm import token_files
from hindcast.operators.reliable import scratch_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["some wörds, and more 字文 😀 of them; don't 12x", " naïve \x1c odd  ones\n\n and a tail \n"]


class NoOffsets:
    def __init__(self, real):
        self.real = real

    def encode(self, *args, **kwargs):
        raise AssertionError("asked for offsets")

    def encode_batch_fast(self, texts, **kwargs):
        return self.real.encode_batch_fast(texts, **kwargs)


def test_new_pieces_need_no_offsets(monkeypatch):
    coder = token_files.Encoder(PATH)
    want = [coder.whole(t) for t in TEXTS]
    monkeypatch.setattr(coder, "tokenizer", NoOffsets(coder.tokenizer))
    assert [ids.tolist() for ids in coder.texts(TEXTS)] == want
    assert [ids.tolist() for ids in coder.texts(TEXTS)] == want  # now remembered


def test_tokens_whose_bytes_do_not_add_up_are_encoded_piece_by_piece():
    coder = token_files.Encoder(PATH)
    coder.n_bytes = np.full_like(coder.n_bytes, 2)
    assert [ids.tolist() for ids in coder.texts(TEXTS)] == [coder.whole(t) for t in TEXTS]


def test_a_worker_need_not_keep_its_pieces(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(40)], "doc_id long, text string")
    token_files.write_token_file(docs, scratch_folder(docs), PATH, remember=12_345, keep=False)

    def remembered(batches):
        for batch in batches:
            own = [len(c.known) + len(c.older) for (_, n), c in token_files._ENCODERS.items()
                   if n == 12_345]
            yield pa.RecordBatch.from_arrays([pa.array([sum(own)], pa.int64())], names=["n"])

    rows = spark.range(64).repartition(16).mapInArrow(remembered, "n long").collect()
    assert {r["n"] for r in rows} == {0}
