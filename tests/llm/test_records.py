"""Binary records: ids against the tokenizers library, the files byte by byte, corruption found."""

import itertools
import struct
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from subsight.llm import records
from subsight.session import scratch_table_path

PATH = public_tokenizers.path(records.VOCABULARY)
ODD = [
    None,
    "",
    " \n ",
    "It's THE end. don't",
    "a  b\n\nc\td",
    "naïve Straße É é x́. İx. ǅ",
    "<|endoftext|> a<|endoftext|>b <|x",
    "1234 5,6%%% ###a",
    "日本語 テキスト 🙂",
    "a\x1cb\xa0c d\x85e",
    "word " * 4000,
    "x" * 2000,
]


def library():
    return Tokenizer.from_file(PATH)


def test_odd_texts(spark):
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(ODD)] * 2, "doc_id long, text string, ids string")
    tokenizer = library()
    rows = records.encode_documents(df, PATH).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        want = tokenizer.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want, repr((ODD[r["doc_id"]] or "")[:40])


def test_query_against_the_library_and_the_files(spark):
    base = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    tokenizer, start, want = library(), 0, set()
    for k in sorted(docs):
        ids = tokenizer.encode(docs[k] or "", add_special_tokens=False).ids + [1]
        want.add((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in records.op3_records(spark, base).collect()} == want


def written(spark, rows, bounds):
    folder = scratch_table_path(spark, "test-records")
    encoded = spark.createDataFrame(rows, "doc_id long, ids binary")
    records.write_records(records.frame_records(encoded, bounds), folder, len(bounds) + 1)
    return folder


def test_files_are_ordered_and_shuffled_reads_work(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), rng.integers(0, 70000 if k % 3 else 256, rng.integers(0, 50)).astype("<u4").tobytes()) for k in rng.permutation(500) - 100]
    rows += [(7, None), (7, b""), (-3, np.array([10, 2570, 0x0A0A], "<u4").tobytes())]
    folder = written(spark, rows, [0, 150, 151, 300])
    data = b"".join(p.read_bytes() for p in sorted(Path(folder, "data").glob("part-*")))
    at, order = 0, []
    while at < len(data):
        (length,) = struct.unpack_from("<Q", data, at)
        assert struct.unpack_from("<I", data, at + 8)[0] == records.masked(data[at : at + 8])
        assert struct.unpack_from("<I", data, at + 12 + length)[0] == records.masked(data[at + 12 : at + 12 + length])
        order.append(struct.unpack_from("<q", data, at + 12)[0])
        at += 17 + length
    assert order == sorted(k for k, _ in rows)
    assert len(list(Path(folder, "data").glob("part-*"))) == 5
    got = records.read_records(spark, folder).collect()
    want = sorted((k, np.frombuffer(v or b"", "<u4").tolist() + [1]) for k, v in rows)
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert [a for a, _ in ends] == [0] + [b for _, b in ends][:-1]
    columns = ["doc_id", "start", "n_tokens", "ids"]
    scanned = records.scan_records(spark, folder).collect()
    assert sorted(tuple(r[c] for c in columns) for r in scanned) == sorted(tuple(r[c] for c in columns) for r in got)
    files = spark.read.parquet(f"{folder}/files").orderBy("shard").collect()
    assert sum(r["records"] for r in files) == len(rows) and [r["base"] for r in files] == [sum(x["ids"] for x in files[:k]) for k in range(len(files))]


def test_corruption_is_found(spark):
    folder = written(spark, [(1, b"\x01\0\0\0"), (2, b"\x02\0\0\0")], [])
    (file,) = Path(folder, "data").glob("part-*")
    good = file.read_bytes()
    Path(folder, "data", f".{file.name}.crc").unlink(missing_ok=True)
    for k in (0, 9, 15, 23, len(good) - 2):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(records.Corrupt):
            at = 0
            while at < len(bad):
                at = records.unframe(bytes(bad), at)[2]
    with pytest.raises(records.Corrupt):
        records.unframe(good[:-1], records.unframe(good, 0)[2])


def test_empty_table_and_null_id(spark):
    folder = written(spark, [], [])
    assert records.read_records(spark, folder).collect() == [] and records.scan_records(spark, folder).collect() == []
    assert records.file_bounds(spark.createDataFrame([], "doc_id long, text string")) == []
    rows = [(3, b"\x05\0\0\0"), (None, b"\x07\0\0\0" * 2), (-(1 << 63), b""), (None, None)]
    got = records.read_records(spark, written(spark, rows, [0])).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -(1 << 63), 3]
    assert sorted(r["n_tokens"] for r in got[:2]) == [1, 3] and [r["start"] for r in got[2:]] == [4, 5]


def test_parts_of_ascii_are_those_of_all_characters():
    for n in (1, 2):
        for unit in map("".join, itertools.product(map(chr, range(128)), repeat=n)):
            general = records.PARTS.findall(unit) if "<|" not in unit and records.PLAIN.fullmatch(unit) else [unit]
            assert records.split_unit(unit) == general


def test_every_plain_letter_and_sign_against_the_library(spark):
    """All characters that go to the model directly, alone, doubled, in upper case and among letters."""
    plain = [c for c in map(chr, range(0x250)) if records.PLAIN.fullmatch(c) and not c.isspace()]
    texts = [t for c in plain for t in (c, c + c, f"ab{c}cd", f"{c.upper()}{c}")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = library()
    for r in records.encode_documents(df, PATH).collect():
        text = texts[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_task_that_knows_too_many_words_begins_anew(spark, monkeypatch):
    from subsight.llm import wordcodes

    monkeypatch.setattr(wordcodes, "KNOWN", 3)
    monkeypatch.setattr(wordcodes, "PLACE_BYTES", 1)
    df = spark.createDataFrame([(k, f"word{k % 7} and {k}") for k in range(600)], "doc_id long, text string").coalesce(1)
    tokenizer = library()
    for r in records.encode_documents(df, PATH).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == tokenizer.encode(f"word{r['doc_id'] % 7} and {r['doc_id']}").ids
