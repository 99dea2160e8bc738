import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import tokenize as T

HERE = T.TOKENIZERS
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a\n  b", "\n\n", "it's we'll I'VE", "x 　y", "日本語 の 文章。", "naïve café́", "<|endoftext|> is text", "\x00\x1c\x85", "🙂🙂 x", "tab\tand\r\nnewline ", "e" * 30_000, "1234 5678,9"]


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.model_of())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(os.path.join(HERE, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_encode_like_the_vocabularys_own_library(encoder, reference, text):
    assert encoder.encode(text) == reference(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'a1.")), max_size=60))
def test_any_text_encodes_alike_and_decodes_to_itself(text):
    e, ref = _shared()
    ids = e.encode(text)
    assert ids == ref(text)
    assert T._decoded(T.read_ranks(os.path.join(HERE, "byte_bpe_50k.tiktoken")) if not hasattr(_shared, "table") else _shared.table, ids) == text


def _shared():
    if not hasattr(_shared, "both"):
        import tiktoken

        path = os.path.join(HERE, "byte_bpe_50k.tiktoken")
        _shared.table = T.read_ranks(path)
        ranks = {t: i for i, t in enumerate(_shared.table)}
        _shared.both = T.Encoder(T.model_of()), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _shared.both


def test_all_documents_equal_the_reference_tokenizer(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in T.encode(docs, keep=["doc_id"]).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == (reference(r.text) if r.text else [])


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y")], "k bigint, text string, ids string")
    got = T.encode(df).collect()
    assert sorted((str(r.k), len(r.ids)) for r in got) == [("1", 2), ("1", 2), ("2", 0), ("None", 0)]
    assert T.encode(df.where("false")).count() == 0
    assert sorted(r.n_tokens for r in T.count_tokens(df).collect()) == [0, 0, 2, 2]
    assert T.decode(T.encode(df), text="back").where("back = 'a b'").count() == 2


def test_the_memory_of_chunks_is_bounded(encoder, monkeypatch, reference):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    for i in range(40):
        assert encoder.encode(f"w{i} v{i} u{i}") == reference(f"w{i} v{i} u{i}")
    assert len(encoder.known) < 20


def test_the_model_is_read_by_the_library_itself():
    import sentencepiece

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    p = sentencepiece.SentencePieceProcessor(model_proto=T.write_model(tokens))
    assert p.get_piece_size() == 259 and p.unk_id() == 258
    assert p.encode(T.letters(b"abcab")) == [257, 256]
