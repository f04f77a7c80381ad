import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.session import tokenizer_folder

pytestmark = pytest.mark.skipif(not os.path.isdir(tokenizer_folder()), reason="no tokenizer files")
TEXTS = ["", "a", " a", "a ", "a  b", "a   b\n\n c \n d", "\n x", "Người bệnh  cần theo dõi 12,5 mg", "👍🏽 ☺️ 腎臓", "<|endoftext|> x", "it's we'll", "x" * 3000, "\t\t a", "a   b", "\r\n\r\n"]


@pytest.fixture(scope="module")
def codec():
    from tessera.llm.encoding import Codec

    return Codec()


def direct(codec, text):
    return codec.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_round_trip(codec, text):
    ids = codec.encode_many([text])[0]
    assert ids == direct(codec, text)
    assert codec.decode(ids) == text
    assert codec.lengths([text, None]) == [len(ids), 0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t ,'đé👍s"), max_size=40))
def test_any_text(codec, text):
    ids = codec.encode_many([text])[0]
    assert ids == direct(codec, text) and codec.decode(ids) == text


def test_offsets_cover_split_characters(codec):
    text = "Thận 👍 ab"
    spans = codec.offsets(text)
    assert spans[0] == (0, 2) and all(b > a for a, b in spans) and spans[-1][1] == len(text)
    assert {c for a, b in spans for c in range(a, b)} == set(range(len(text)))


def test_corpus(spark, codec):
    from tessera.llm.encoding import decode_corpus, encode_corpus, token_counts

    df = spark.createDataFrame([*enumerate(TEXTS), (99, None), (1, "a")], "doc_id long, text string").selectExpr("*", "'clash' as ids")
    got = encode_corpus(df)
    out = {(r.doc_id, tuple(r.ids)) for r in got.collect()}
    assert out == {(i, tuple(direct(codec, t))) for i, t in enumerate(TEXTS)} | {(99, ())} and got.count() == len(TEXTS) + 2
    back = {r.doc_id: r.text for r in decode_corpus(got).collect()}
    assert back == dict(enumerate(TEXTS)) | {99: ""}
    assert {r.doc_id: r.tokens for r in token_counts(df).collect()}[99] == 0
    assert encode_corpus(df.limit(0)).count() == 0


def test_long_chunks_are_remembered_for_one_batch_only(codec):
    long = "x" * 5000
    assert codec.encode_many([long, f"a {long}", long]) == [direct(codec, t) for t in (long, f"a {long}", long)]
    assert codec.lengths(["b"]) == [1] and long not in codec.first and long not in codec.later
