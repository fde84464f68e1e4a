import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe
from tests.llm.conftest import EDGE

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as file:
    RANKS = bpe.parse_ranks(file.read())
LIBRARY = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, bpe.class_table("tiktoken"))
ALPHABET = st.sampled_from([*"absterlvmdz09.,-' \n\t\r", " ", "\x1c", "é", "漢", "́", "😀", "'s", "'ll", "  ", " "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=40).map("".join), min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    found = CODEC.encode(texts)
    assert found == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [CODEC.decode(ids).decode() for ids in found] == texts


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    (ids,) = CODEC.encode([text])
    assert ids == LIBRARY.encode_ordinary(text)


def test_very_long_pieces():
    text = "a" * 5000 + "ab" * 2000 + " " + "é" * 900 + " " * 3000 + "!?" * 1000
    assert CODEC.encode([text]) == [LIBRARY.encode_ordinary(text)]


def test_class_tables_of_both_libraries_agree():
    assert (bpe.class_table("tiktoken") == bpe.class_table("tokenizers")).all()


def test_encode_and_decode_keep_rows_and_columns(edge):
    encoded = bpe.encode(edge, PATH)
    assert encoded.columns[-2:] == ["ids", "offsets"] and "key" in encoded.columns
    rows = bpe.decode(encoded, PATH).collect()
    assert len(rows) == len(EDGE)
    for row in rows:
        raw = (row.text or "").encode()
        assert bytes(row.decoded) == raw and row.ids == LIBRARY.encode_ordinary(row.text or "")
        assert row.offsets[0] == 0 and row.offsets[-1] == len(raw)


def test_digests(edge, documents):
    for docs in (edge, documents):
        wanted = sorted(
            (str(r.doc_id), len(ids := LIBRARY.encode_ordinary(r.text or "")),
             hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((r.text or "").encode()).hexdigest())
            for r in docs.select("doc_id", "text").collect()
        )
        found = sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(docs, PATH).collect())
        assert found == wanted


@pytest.mark.parametrize("operator", [bpe.round_trip, bpe.encode])
def test_empty_table(nothing, operator):
    assert operator(nothing, PATH).count() == 0


@pytest.mark.parametrize("at_once", [1 << 16, 3])
def test_texts_are_decoded_at_their_offsets(spark, monkeypatch, at_once):
    monkeypatch.setattr(bpe, "DECODED_IDS", at_once)
    codec = bpe.codec_maker(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))()
    texts = ["", "a", "Ünïcödé 漢字 \U0001f600 \x00", "", "the same words " * 500, "\n\n  x"]
    ids = codec.encode(texts)
    assert codec.decode_all(ids) == [t.encode() for t in texts]
    assert codec.decode_all([]) == [] and codec.decode([]) == b""
    for text, own in zip(texts, ids):
        at = codec.offsets(own)
        assert [text.encode()[a:b] for a, b in zip(at, at[1:])] == [codec.bytes_of[i] for i in own]
    for wrong in (-1, 10**7):
        with pytest.raises(KeyError):
            codec.decode([0, wrong])
