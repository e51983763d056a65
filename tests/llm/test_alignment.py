"""Alignment against the libraries on whole texts, with links by comparing byte ranges pairwise."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from subsight.llm import alignment

PATHS = [public_tokenizers.path(n) for n in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)]
ODD = [
    None, "", " ", "   ", "\n", "a  b", "a \n b", "a\n  b", "it's don't I'll 'S x's", " lead", "trail  ", "trail ", "tab\t tab \t\tend",
    "a\x1cb\x1c \x1cc", "a  b  c  d", "1234 56,789 3.14", "naïve café Straße", "é café ﬁ", "日本語 テキスト 中文", "🙂🙂 emoji‍ x",
    "<|endoftext|> x <|endoftext|>", "<s> </s> <unk> <0x41>", "a▁b", "▁", "x ▁ y", "word " * 3000, "x" * 3000, "\x00 ﻿", "a\xa0 b 　 c  d\r\n e",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(token_bytes):
    out, at = [], 0
    for b in token_bytes:
        out.append((at, at + len(b)))
        at += len(b)
    return out


def plain(texts, libraries):
    """The contract, word by word, in Python; texts are short."""
    a_lib, b_lib = libraries
    a_bytes, b_bytes = alignment.tokenizer_a(PATHS[0])[1], alignment.tokenizer_b(PATHS[1])[1]
    found, counts = [], Counter()
    for text in texts:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        want = b" " + (text or "").encode()
        ab, bb = [a_bytes[k] for k in a], [b_bytes[k] for k in b]
        if not text or b"".join(ab) != want or b"".join(bb) != want:
            found.append(None)
            continue
        sa, sb = spans(ab), spans(bb)
        links = [(x, y) for x, (p, q) in zip(a, sa) for y, (r, s) in zip(b, sb) if p < s and r < q] if len(text) < 300 else None
        if links is None:  # the same by elementary ranges
            ends = sorted({e for _, e in sa} | {e for _, e in sb})
            of = lambda spans_: {e: k for k, (s, t) in enumerate(spans_) for e in range(s + 1, t + 1)}
            fa, fb = of(sa), of(sb)
            links = [(a[fa[e]], b[fb[e]]) for e in ends]
        both = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([], []) for _ in both]
        for side, ids, ranges in ((0, a, sa), (1, b, sb)):
            for k, (_, end) in zip(ids, ranges):
                groups[bisect_left(both, end)][side].append(str(k))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in groups]
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


def test_odd_texts_against_the_libraries(spark, libraries):
    rows = [(k, t, 7, "z") for k, t in enumerate(ODD)] * 2 + [(None, "a  b", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, n_links string")
    want = plain([r[1] for r in rows], libraries)
    got = sorted((tuple(r) for r in alignment.align_documents(df, *PATHS).collect()), key=str)
    assert got == sorted([(r[0], *w) for r, w in zip(rows, want)], key=str)


def test_small_blocks_and_salts_give_the_same(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 10)
    monkeypatch.setattr(alignment, "SALT_BLOCKS", 2)
    monkeypatch.setattr(alignment, "PART_CHUNK", 5)
    texts = [t for t in ODD if t is None or len(t) < 100] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in alignment.align_documents(df, *PATHS).collect())
    assert got == [(k, *w) for k, w in enumerate(plain(texts, libraries))]


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_query_against_the_libraries(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = plain([r["text"] for r in docs], libraries)
    got = {r[0]: tuple(r)[1:] for r in alignment.op11_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d["doc_id"]: w for d, w in zip(docs, want)}


@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_groups_and_links_of_any_cuts(a, b):
    short, long = (a, b) if sum(a) < sum(b) else (b, a)
    short += [1] * (sum(long) - sum(short))  # both sides cover the same bytes
    size = np.arange(5)
    found = alignment.align([a, b], [b, a], size, size)  # and the sides changed

    def ends(s):
        return [sum(s[: k + 1]) for k in range(len(s))]

    assert found.n_groups.tolist() == [len(set(ends(a)) & set(ends(b)))] * 2
    assert found.n_links.tolist() == [len(set(ends(a)) | set(ends(b)))] * 2
    groups = [g.split("|") for g in found.shown[0].split(";")]
    assert [int(x) for g in groups for x in g[0].split(",")] == a and [int(x) for g in groups for x in g[1].split(",")] == b
    assert all(sum(map(int, x.split(","))) == sum(map(int, y.split(","))) for x, y in groups)
    first = found.links[: found.n_links[0]]
    want = [(y << 32) | x for k, x in enumerate(a) for m, y in enumerate(b) if ends(a)[k] - x < ends(b)[m] and ends(b)[m] - y < ends(a)[k]]
    assert sorted(first.tolist()) == sorted(want)


@pytest.fixture(scope="module")
def encoders():
    return alignment.tokenizer_a(PATHS[0])[0], alignment.tokenizer_b(PATHS[1])[0]


@given(text=st.text(alphabet=st.sampled_from(list("ab é\n\t' .5日\x1c\xa0")), max_size=30))
@settings(max_examples=300, deadline=None)
def test_parts_are_what_both_tokenizers_cut(encoders, text):
    parts = alignment.parts_of(text)
    assert "".join(" " + p for p in parts) == " " + text
    for encode in encoders:
        assert [k for ids in encode(parts) for k in ids] == encode([text])[0]
