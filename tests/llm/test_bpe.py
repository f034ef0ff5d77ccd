import os

import pytest
from pyspark.sql import functions as F

from quern.llm import bpe

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public tokenizer files here")
TEXTS = ["Xin chào các bạn", "it's I'LL don’t", "  a  b\n\n c \t", "<|endoftext|> hi", "😀😀 123456 ½²", "\u200b\x85 x", "aaaa" * 3000, "กำ ́x", "học phí 5.000.000 đồng/kỳ", "\ufffd\x00 z"]


def test_ids_equal_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    assert bpe.Encoder(PATH).encode_batch(TEXTS) == [e.ids for e in lib.encode_batch(TEXTS, add_special_tokens=False)]


def test_random_words_equal_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    from hypothesis import given, settings
    from hypothesis import strategies as st

    lib = tokenizers.Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    encoder = bpe.Encoder(PATH)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40), max_size=5))
    def check(texts):
        assert encoder.encode_batch(texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]

    check()


def test_null_empty_repeated_and_no_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Xin chào", "x"), (3, "Xin chào", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(df, F.col("doc_id"), F.col("text")).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) > 1
    counts = {r.doc_id: r.tokens for r in bpe.token_counts(df, F.col("doc_id"), F.col("text")).collect()}
    assert counts == {1: 0, 2: 0, 3: len(got[2][1])}
    assert bpe.encode(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_memory_of_words_does_not_change_ids(monkeypatch):
    want = bpe.Encoder(PATH).encode_batch(TEXTS)
    monkeypatch.setattr(bpe, "MEMORY", 1)
    encoder = bpe.Encoder(PATH)
    assert [encoder.encode_batch([t])[0] for t in TEXTS] == want
