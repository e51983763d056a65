"""Byte-level BPE: encoding through a global shuffle of distinct words, decoding by the token-byte table.

Texts become pre-tokens with positions, each distinct pre-token of the corpus is encoded once and
its ids are joined back and put together by position (``wordcodes``). Decoding looks every id up in
the table of token bytes, which is as large as the vocabulary file and no larger.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from subsight.llm.common import spare_name, table
from subsight.llm.wordcodes import encode_corpus

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of lowest rank (the first of equal ones) is joined until none has a rank.

    Parts are kept by where they begin, each with the beginnings of its neighbours, and ranked pairs
    in a heap; a pair whose parts have changed since is passed over. Long words take n log n.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n + 1)

    def ranked(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        if j >= n or (rank := ranks.get(word[i : after[j]])) is None:
            return None
        return rank, i, after[j]

    heap = [pair for i in range(n - 1) if (pair := ranked(i))]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if gone[i] or j >= n or after[j] != end:
            continue
        gone[j], after[i] = 1, end
        if end < n:
            before[end] = i
        for k in (before[i], i):
            if k >= 0 and (pair := ranked(k)):
                heappush(heap, pair)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def _encoded(docs: DataFrame, path: str, pattern: str, **options) -> DataFrame:
    def encoder():
        ranks = read_ranks(path)
        return lambda words: [np.array(merge_word(w, ranks), "<u4").tobytes() for w in words]

    return encode_corpus(docs, regex.compile(pattern).findall, True, encoder, **options)


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` per row of ``docs``; ``ids`` are little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Texts of any length, repeated rows and null ``doc_id`` are
    encoded like any other. Columns other than ``doc_id`` and ``text`` are not read. An empty
    table gives an empty result.
    """
    return _encoded(docs, path, pattern)


def _decode(ids: bytes, token_bytes: dict[int, bytes]) -> bytes:
    return b"".join(map(token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the bytes of each row's ``ids`` (null: null) in the column ``decoded``; where ``encoded`` has such a column, in ``decoded_2`` (and so on)."""
    name = spare_name(encoded.columns, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = dict(map(reversed, read_ranks(path).items()))
        for batch in batches:
            found = [None if ids is None else _decode(ids, token_bytes) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, name])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in encoded.dtypes), f"{name} binary"])
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row, encoded and decoded again.

    As ``decode_documents(encode_documents(docs))``, but ids and bytes stay where they are made.
    """

    def finish(rows: pa.Table) -> pa.Table:
        token_bytes = dict(map(reversed, read_ranks(path).items()))
        ids = rows["ids"].to_pylist()
        own = [hashlib.sha256(x).hexdigest() for x in ids]
        back = [hashlib.sha256(_decode(x, token_bytes)).hexdigest() for x in ids]
        return pa.table({"doc_id": rows["doc_id"], "n_tokens": rows["n_tokens"], "ids_sha256": pa.array(own, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return _encoded(docs, path, pattern, finish=finish, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
