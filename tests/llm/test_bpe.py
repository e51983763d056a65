"""BPE encoding against the tiktoken library, decoding as an exact round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from subsight.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
ODD = [
    None,
    "",
    " ",
    "   ",
    "\n",
    "a  b",
    "a \n b",
    "it's don't I'll 'S x's",
    " lead",
    "trail  ",
    "tab\t tab \t\tend",
    "a\x1cb\x1c \x1cc",
    "a  b  c  d",
    "1234 56,789 3.14",
    "naïve café été Straße ñandú",
    "日本語 テキスト 中文",
    "🙂🙂 emoji‍ x",
    "<|endoftext|> x <|endoftext|>",
    "é İ ǅ",
    "word " * 5000,
    "x" * 3000,
    "\x00 ﻿",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def check(rows, texts, library):
    for r in rows:
        text = texts[r["doc_id"]] or ""
        want = library.encode_ordinary(text)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want, repr(text[:60])
        assert r["n_tokens"] == len(want)
        assert bytes(r["decoded"]) == text.encode()


def test_odd_texts(spark, library):
    texts = dict(enumerate(ODD))
    df = spark.createDataFrame([(k, t, "z", 1) for k, t in texts.items()] * 2, "doc_id long, text string, ids string, block int")
    rows = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).collect()
    assert len(rows) == 2 * len(ODD)
    check(rows, texts, library)


def test_long_words(library):
    ranks = bpe.read_ranks(PATH)
    for word in ("x" * 40_000, "ab" * 9_000, "".join(chr(97 + k * k % 26) for k in range(30_000)), "日本" * 4000, "aaaaaab" * 700):
        assert bpe.merge_word(word.encode(), ranks) == library._encode_single_piece(word.encode())


def test_a_column_named_decoded_stays(spark):
    ids = np.array([1, 2], "<u4").tobytes()
    df = spark.createDataFrame([(1, "mine", bytearray(ids)), (2, "too", None)], "doc_id long, decoded string, ids binary")
    rows = {r["doc_id"]: r for r in bpe.decode_documents(df, PATH).collect()}
    assert rows[1]["decoded"] == "mine" and rows[1]["decoded_2"] and rows[2]["decoded_2"] is None


def test_empty_table_and_null_id(spark):
    schema = "doc_id long, text string"
    assert bpe.digests(spark.createDataFrame([], schema), PATH).collect() == []
    (row,) = bpe.digests(spark.createDataFrame([(None, None)], schema), PATH).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(row) == (None, 0, nothing, nothing)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    check(rows, texts, library)
    for r in bpe.op2_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
