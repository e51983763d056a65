"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Record, all integers little-endian:

    length   u64   bytes of the payload
    check    u32   masked crc32 of the eight length bytes
    payload        doc_id i64, width u8 (bytes of an id: 2 or 4; 128 more where doc_id is null), ids
    check    u32   masked crc32 of the payload
    end      u8    0x0A

A masked checksum is the crc32 rotated right by 15 bits plus 0xA282EAD8, modulo 2^32, so that the
checksum of bytes that hold checksums says something.

The data set is a folder with ``data`` (files of records in ascending order of ``doc_id``; the file
number is the order), ``index`` (a table: file number, offset and size of each record, and the
number of ids in all records before it) and ``files`` (a table: records and ids of each file, and the
number of ids in all files before it). All are written by Spark's own writers, with their commit
protocol: a lost executor's files are written again, and any file system that Spark reaches will do.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subsight.llm.alignment import byte_letters
from subsight.llm.common import landed, table
from subsight.llm.wordcodes import encode_in_place
from subsight.session import scratch_table_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Set in the width of a record without a doc_id.
NO_ID = 128
#: Payload bytes per file, about: a file is read by one task.
FILE_BYTES = 8 << 20

#: Characters with which letters, digits and signs can be told apart before the tokenizer's own
#: normalisation: no marks that combine, none whose lower case is two characters, no apostrophe.
PLAIN = regex.compile(r"[ \t\n\r!-&(-~À-įı-ɏ]+")
PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: What the two come to for ASCII, for the faster library.
ASCII_PLAIN = re.compile(r"[ \t\n\r!-&(-~]+")
ASCII_PARTS = re.compile(r"[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+")
#: The characters of ``PLAIN`` from the letters on; all but two of them are letters.
LATIN = re.compile(r"[A-Za-zÀ-įı-ɏ]+")


def split_unit(unit: str) -> list[str]:
    """Parts of a unit (text between spaces) that the tokenizer would encode on their own; the unit where that is not sure."""
    if unit.isascii():
        return ASCII_PARTS.findall(unit) if "<|" not in unit and ASCII_PLAIN.fullmatch(unit) else [unit]
    return PARTS.findall(unit) if "<|" not in unit and PLAIN.fullmatch(unit) else [unit]


def one_part(word: str) -> bool:
    """Whether ``split_unit`` would have given the word as a part of a unit (and not for want of knowing better)."""
    if word.isalpha():
        return bool(LATIN.fullmatch(word))
    plain, parts = (ASCII_PLAIN, ASCII_PARTS) if word.isascii() else (PLAIN, PARTS)
    return "<|" not in word and bool(plain.fullmatch(word) and parts.fullmatch(word))


def _encoded(docs: DataFrame, path: str, **options) -> DataFrame:
    def encoder():
        import os
        from array import array

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, as_bytes = Tokenizer.from_file(path), {b: chr(c) for c, b in byte_letters().items()}
        merged = tokenizer.model.tokenize

        def encode(words: list[bytes]) -> list[bytes]:
            # normalisation and cutting leave a part but for its case: the library's model gets it as it is
            texts, out = [w.decode() for w in words], []
            for text in texts:
                if one_part(text):
                    lower = text.lower()
                    ids = [t.id for t in merged(lower if lower.isascii() else "".join(map(as_bytes.__getitem__, lower.encode())))]
                    out.append(array("I", ids).tobytes())
                else:
                    out.append(None)
            rest = [k for k, ids in enumerate(out) if ids is None]
            for k, found in zip(rest, tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = array("I", found.ids).tobytes()
            return out

        return encode

    return encode_in_place(docs, split_unit, False, encoder, **options)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` by the tokenizers library's file at ``path``, no special tokens added.

    Words are encoded once each, without regard to where they stand; null and empty texts have no ids.
    """
    return _encoded(docs, path)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    head = struct.pack("<qB", 0, width | NO_ID) if doc_id is None else struct.pack("<qB", doc_id, width)
    payload = head + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), b"\n"))


class Corrupt(ValueError):
    """A record whose lengths or checksums don't hold."""


def unframe(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """``(doc_id, ids, where the next record begins)`` of the record at ``at``."""
    if len(data) < at + 12:
        raise Corrupt(f"truncated at {at}")
    (length,), (check,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
    if masked(data[at : at + 8]) != check or len(data) < at + 17 + length:
        raise Corrupt(f"length at {at}")
    payload, end = data[at + 12 : at + 12 + length], at + 17 + length
    if struct.unpack_from("<I", data, end - 5)[0] != masked(payload) or data[end - 1] != 10:
        raise Corrupt(f"payload at {at}")
    doc_id, width = struct.unpack_from("<qB", payload)
    doc_id = None if width & NO_ID else doc_id
    return doc_id, np.frombuffer(payload, f"<u{width & ~NO_ID}", offset=9).astype("<u4"), end


def file_bounds(docs: DataFrame, file_bytes: int = FILE_BYTES) -> list[int]:
    """The smallest ``doc_id`` of each file but the first, for files of about ``file_bytes`` of ids."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-chars // (2 * file_bytes)))  # two bytes of text or more come to one byte of ids
    if files == 1:
        return []
    shares = [k / files for k in range(1, files)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 20 * files)).first()[0]
    return sorted(set(found or []))


FRAMED = "file int, doc_id long, record binary"


def _framed(rows: pa.Table | pa.RecordBatch, bounds: list[int], end_id: int) -> pa.Table:
    doc_ids = rows.column("doc_id").to_pylist()
    records = [frame(k, np.append(np.frombuffer(raw or b"", "<u4"), np.uint32(end_id))) for k, raw in zip(doc_ids, rows.column("ids").to_pylist(), strict=True)]
    least = np.iinfo(np.int64).min  # null ids come first
    file = np.searchsorted(np.array(bounds, np.int64), np.array([least if k is None else k for k in doc_ids], np.int64), "right").astype(np.int32)
    # the line end that closes a record is the one that the text writer adds
    return pa.table({"file": pa.array(file), "doc_id": pa.array(doc_ids, pa.int64()), "record": pa.array([r[:-1] for r in records], pa.binary())})


def frame_records(encoded: DataFrame, bounds: list[int], end_id: int = END_ID) -> DataFrame:
    """``(file, doc_id, record)``: ``encoded`` (``doc_id, ids``; null ids: none) with ``end_id`` after each record's ids.

    ``bounds`` cut the files (``file_bounds``). Rows with a null ``doc_id`` come before all others,
    in the order of their records. Repeated rows are records each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _framed(batch, bounds, end_id).to_batches()

    return encoded.select("doc_id", "ids").mapInArrow(run, FRAMED)


def encode_framed(docs: DataFrame, path: str, bounds: list[int], end_id: int = END_ID) -> DataFrame:
    """``frame_records(encode_documents(docs))``, the ids staying where they are made."""
    return _encoded(docs, path, finish=lambda rows: _framed(rows, bounds, end_id), schema=FRAMED)


def write_records(framed: DataFrame, folder: str, files: int) -> None:
    """Write framed records into ``files`` files and an index. An empty table gives an empty data set."""
    spark = framed.sparkSession
    ordered = framed.repartitionById(files, "file").sortWithinPartitions("doc_id", "record")
    # bytes go through a string column as they are: nothing checks or changes them
    ordered.select(F.col("record").cast("string").alias("value")).write.mode("errorifexists").text(f"{folder}/data")
    # the index is read off the files, so it says what is in them
    index = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").mapInArrow(
        _index_rows, "shard int, at long, size long, doc_id long, n long"
    )
    stored = landed(index, "record-index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    shards = stored.groupBy("shard").agg(F.count("*").alias("records"), F.sum("n").alias("ids"))
    shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.mode("errorifexists").parquet(f"{folder}/files")
    within = Window.partitionBy("shard").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    bases = spark.read.parquet(f"{folder}/files").select("shard", "base")
    started = stored.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(bases, "shard")
    started.select("shard", "at", "size", "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n").write.mode("errorifexists").parquet(f"{folder}/index")


def _shard_of(path: str) -> int:
    return int(path.rsplit("part-", 1)[1].split("-", 1)[0])


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows, at, shard = [], 0, _shard_of(path)
            while at < len(data):
                doc_id, ids, end = unframe(data, at)
                rows.append((shard, at, end - at, doc_id, len(ids)))
                at = end
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "at", "size", "doc_id", "n"])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``: each record by its place in the index, checksums verified.

    For shuffled reads, or reads of a part of the index; ``scan_records`` reads all in the order of the files. A file and the places of its records meet in one task; any order of places can be asked for.
    """
    index = spark.read.parquet(f"{folder}/index")
    name = F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").select(name, "content")

    def read(places: pa.Table, files: pa.Table) -> pa.Table:
        data, rows = files["content"][0].as_py() if len(files) else b"", []
        for at, start, n, wanted in zip(*(places[c].to_pylist() for c in ("at", "start", "n", "doc_id")), strict=True):
            doc_id, ids, _ = unframe(data, at)
            if (doc_id, len(ids)) != (wanted, n):
                raise Corrupt(f"the index is not of this file at {at}")
            rows.append((doc_id, start, n, ids.tobytes()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = zip(*rows, strict=True) if rows else ([],) * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    return index.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["shard", "inner", "doc_id", "n_tokens", "ids"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data, at, inner, shard = content.as_py(), 0, 0, _shard_of(path)
            while at < len(data):
                rows = []
                while at < len(data) and len(rows) < 1000:
                    doc_id, ids, at = unframe(data, at)
                    rows.append((shard, inner, doc_id, len(ids), ids.tobytes()))
                    inner += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read_records``, for all records: each file is read from its beginning and moves nowhere.

    A record's lengths and checksums say where the next one begins; ``start`` counts on from the
    file's place in the table of files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")
    rows = files.select("path", "content").mapInArrow(_scan_rows, "shard int, inner long, doc_id long, n_tokens long, ids binary")
    bases = spark.read.parquet(f"{folder}/files").select("shard", "base")
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids")


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = scratch_table_path(spark, "llm-records"), table(spark, sf_dir, "documents")
    bounds = file_bounds(docs)
    write_records(encode_framed(docs, public_tokenizers.path(VOCABULARY), bounds), folder, len(bounds) + 1)
    return scan_records(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
