"""Repeated strings against brute force over all windows; the suffix array against plain sorting."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from subsight.llm import suffix_dedup as sd
from subsight.llm.suffix_array import equal_prefixes, suffix_order


def plain(rows, length=50):
    """Per row what is left: ``(id, bytes, removed, spans, kept)``."""
    no_id = 1 << 63
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, no_id), no_id if k is None else k)
    out = []
    for k, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (no_id if k is None else k):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def result(df, **options):
    left, n = sd.remove_repeats(df, **options)
    return sorted(((r["doc_id"], r[n["n_bytes"]], r[n["n_removed"]], r[n["n_spans"]], bytes(r[n["kept"]])) for r in left.collect()), key=str)


def test_suffix_order_and_classes():
    rng = np.random.default_rng(0)
    for k in range(600):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))
        s = np.tile(s[: max(1, len(s) // 4)], 5) if k % 3 == 0 and len(s) else s
        assert suffix_order(s, 10**9).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        depth = int(rng.integers(1, 20))
        prefixes = [s[i : i + depth].tolist() for i in suffix_order(s, depth)]
        assert prefixes == sorted(prefixes) and len(prefixes) == len(s)
        length = int(rng.integers(1, 8))
        starts = np.arange(max(0, len(s) - length + 1))
        classes = {}
        for i, c in zip(starts, equal_prefixes(s, starts, length), strict=True):
            assert classes.setdefault(c, s[i : i + length].tolist()) == s[i : i + length].tolist()
        assert len(classes) == len({tuple(s[i : i + length].tolist()) for i in starts})


def made_up(rng, n=70):
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randint(8, 60)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(0, 30)) for _ in range(rng.randint(1, 5))]
        t = "".join(parts)
        if texts and rng.random() < 0.4:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("xyz")
            t = "".join(t)
        texts.append(t)
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_made_up_texts(spark, monkeypatch, small):
    if small:  # many blocks, slices, segments, arrays, crowded grams and hot deals
        for name, value in {"BLOCK_BYTES": 4000, "SEGMENT": 700, "SLICE_BYTES": 5000, "MANY": 3, "ARRAY_BYTES": 300}.items():
            monkeypatch.setattr(sd, name, value)
    texts = made_up(random.Random(5))
    ids = random.Random(6).sample(range(-50, 400), len(texts))
    rows = list(zip(ids, texts, strict=True))
    rows += [(ids[3], texts[3]), (ids[4], texts[5]), (None, texts[6]), (None, texts[6]), (None, "q" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    want = plain(rows)
    assert sum(w[2] for w in want) > 1000
    assert result(df, hot=2 if small else sd.HOT) == want


def test_deals_against_plain_windows():
    rng, length = random.Random(11), 6
    for n in (1, 2, 40, 400):
        # pieces of one deal share their middle; some deals have one text only, some texts stand in two deals
        rows = sorted(((k := rng.randrange(max(1, n // 4))), rng.randrange(9), f"{'ab' * (k % 2)}x{k:04d}{rng.choice(['', 'y', 'yz'])}") for _ in range(n))
        key, doc, text = (list(c) for c in zip(*rows, strict=True))
        first = {}
        for d, t in zip(doc, text, strict=True):
            for i in range(len(t) - length + 1):
                first[t[i : i + length]] = min(first.get(t[i : i + length], 99), d)
        # a window counts where its deal's content, the number, is in it
        got = sd.class_deals(np.array(key), np.array(doc), pa.array([t.encode() for t in text], pa.binary()), length).to_pylist()
        for k, t, least in zip(key, text, got, strict=True):
            seen = np.frombuffer(least, "<i8").tolist()
            assert len(seen) == len(t) - length + 1
            for i, d in enumerate(seen):
                if f"{k:04d}" in t[i : i + length]:
                    assert d == first[t[i : i + length]]


def test_odd_texts_and_columns(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 500), (5, "a" * 300), (6, "ab" * 70000), (7, "ba" * 400), (8, "é" * 25), (9, "x" + "é" * 25), (9, "x" + "é" * 25)]
    df = spark.createDataFrame([(7, "s", k, t, None) for k, t in rows], "n_bytes int, kept string, doc_id long, text string, id int")
    left, names = sd.remove_repeats(df)
    assert left.columns[:5] == df.columns and names["kept"] == "kept_2" and names["n_bytes"] == "n_bytes_2"
    assert result(df) == plain(rows)
    got = {(r["n_bytes"], r["kept"], r["doc_id"], r["text"], r["id"]) for r in left.collect()}
    assert got == {(7, "s", k, t, None) for k, t in rows}


def test_empty_table_and_length(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert result(empty) == []
    with pytest.raises(ValueError):
        sd.remove_repeats(empty, length=20)
    rows = list(enumerate(made_up(random.Random(9), 30)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (32, 41, 64):
        assert result(df, length=length) == plain(rows, length)


def test_query_against_brute_force(spark):
    base = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    want = [(k, n, r, s, hashlib.sha256(b).hexdigest()) for k, n, r, s, b in plain(rows)]
    assert sorted(map(tuple, sd.op6_suffix(spark, base).collect()), key=str) == want
    assert any(r for _, _, r, _, _ in want)
