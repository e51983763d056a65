"""Tokenise a corpus through its distinct words.

1. ``pack``: texts are gathered into blocks of bounded size. In its block each document becomes
   the ordered list of its words, written as numbers into the block's list of distinct words.
2. The distinct words of all blocks are shuffled by a hash of the word (its slice): each distinct
   word is encoded once, however many blocks ask for it.
3. The ids go back to their blocks, where the documents are put together again by position.

A word travels at most once from each block, never once for each occurrence, and the words of a
slice travel compressed together, so the shuffles stay smaller than the texts.

``encode_in_place`` does without the shuffle: a task encodes the distinct words of its own blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsight.llm.common import lean_memory, small_batches

#: Text bytes gathered into one block (a longer text is a block of its own).
BLOCK_BYTES = 6 << 20
#: The same for ``encode_in_place``, which holds words, ids and documents at a time.
PLACE_BYTES = 3 << 20
#: Slices of the vocabulary; a task holds the distinct words of one slice at a time.
SLICES = 256
#: Words whose ids a task keeps from block to block in ``encode_in_place``; it begins anew beyond.
KNOWN = 1 << 19

Split = Callable[[str], Sequence[str]]
Encode = Callable[[list[bytes]], list[bytes]]


def _planes(codes: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; far smaller in a shuffle than the text or the numbers."""
    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplanes(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _words_by_slice(words: pa.Array, slices: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """``(slice, n, packed)``: the words of each slice in the order of their numbers, sizes first."""
    order = np.argsort(slices, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(slices, minlength=SLICES)))).tolist()
    sorted_words, press = words.take(pa.array(order)), zstandard.ZstdCompressor(level=3).compress
    if len(words):
        edges = np.frombuffer(sorted_words.buffers()[1], "<i4")[: len(words) + 1]
        data, sizes = memoryview(sorted_words.buffers()[2] or b""), np.diff(edges).astype("<u4")
    for k in range(SLICES):
        if (n := cuts[k + 1] - cuts[k]) > 0:
            yield k, n, press(sizes[cuts[k] : cuts[k + 1]].tobytes() + data[edges[cuts[k]] : edges[cuts[k + 1]]])


def _unpack_words(packed: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    edge = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64))) + 4 * n
    return [raw[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of every range, one after the other."""
    out = np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _pack_block(texts: pa.Array, split: Split, spaced: bool, body: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(words, numbers of all documents, words per document)`` of one block; without ``body`` only the words.

    Texts are cut before each space; with ``spaced`` the space belongs to the unit it begins.
    Such a cut is none for the tokeniser where white space stands before the space: documents
    that have such a place are one unit.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.split_pattern(texts, " ")
    coded = parts.values.dictionary_encode()
    units, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).copy()
    offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    first, counts, whole = offsets[:-1], np.diff(offsets), np.zeros(len(texts), bool)
    lead = " " if spaced else ""
    # a single run of letters is one word
    single = np.array(pc.ascii_is_alpha(units).to_numpy(zero_copy_only=False), bool)
    rest = np.flatnonzero(~single)
    strings = units.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
    letters = np.fromiter(map(str.isalpha, strings), bool, len(strings))
    single[rest[letters]] = True
    rest, strings = rest[~letters], [u for u, alone in zip(strings, letters.tolist(), strict=True) if not alone]
    found = [split(lead + u) if lead + u else () for u in strings]
    if spaced:
        ends_blank = np.zeros(len(units), bool)
        ends_blank[rest[np.fromiter((not u or u[-1].isspace() for u in strings), bool, len(strings))]] = True
        last = np.zeros(len(at), bool)
        last[offsets[1:] - 1] = True
        whole[np.repeat(np.arange(len(texts)), counts)[ends_blank[at] & ~last]] = True
        # a text's first unit has no space before it
        begins = units.take(pa.array(at[first])).to_pylist()
        for k in np.flatnonzero(whole).tolist():
            begins[k] = texts[k].as_py()
        found += [split(u) if u else () for u in begins]
    alone = units.filter(pa.array(single))
    if spaced:
        alone = pc.binary_join_element_wise(lead, alone, "")
    numbered = pa.concat_arrays([alone.cast(pa.string()), pa.array([w for words in found for w in words], pa.string())]).dictionary_encode()
    words = numbered.dictionary.cast(pa.binary())
    if not body:
        return words, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    number = numbered.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
    of_found = np.fromiter(map(len, found), np.int64, len(found))
    del parts, coded, numbered, found
    # a unit's words, as a range of ``number``: first those that are one word, then all others in turn
    sizes, starts = np.ones(len(units), np.int64), np.cumsum(single) - 1
    after = len(alone) + np.cumsum(of_found) - of_found
    sizes[rest], starts[rest] = of_found[: len(rest)], after[: len(rest)]
    if spaced:
        sizes, starts = np.concatenate((sizes, of_found[len(rest) :])), np.concatenate((starts, after[len(rest) :]))
        at[first] = len(units) + np.arange(len(texts))
        keep = ~np.repeat(whole, counts)
        keep[first] = True
        at, counts = at[keep], np.where(whole, 1, counts)
    per_unit = sizes[at]
    codes = number[_ranges(starts[at], per_unit)] if len(number) else number
    ends = np.cumsum(per_unit)[np.cumsum(counts) - 1]
    return words, codes, np.diff(ends, prepend=0)


def _gathered(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows in blocks of about ``block_bytes`` of text, cut at every 128 rows of the partition, wherever its batches end."""
    held, size, seen = [], 0, 0
    for batch in batches:
        low = 0
        while low < batch.num_rows:
            piece = batch.slice(low, 128 - seen % 128)
            low, seen = low + piece.num_rows, seen + piece.num_rows
            held.append(piece)
            size += pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
            if size >= block_bytes and seen % 128 == 0:
                yield held
                held, size = [], 0
    if held:
        yield held


def pack(docs: DataFrame, split: Split, spaced: bool, want: str = "both") -> DataFrame:
    """Per block one row of its documents (``slice`` -1) and one for each slice of its words.

    ``want`` leaves out the rows of ``body`` or of ``words``. Block numbers come from the partition
    and the order in it: ``docs`` must be a read that gives the same rows again (a stored table),
    else use ``want='both'`` and store the result.
    """
    body, listed = want in ("both", "body"), want in ("both", "words")
    names = ["block", "slice", "doc_ids", "counts", "n", "packed", "slices"]

    def flush(held: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
        doc_ids = [k for b in held for k in b.column("doc_id").to_pylist()]
        words, codes, counts = _pack_block(pa.concat_arrays([b.column("text") for b in held]), split, spaced, body)
        slices = np.fromiter((zlib.crc32(w) % SLICES for w in words.to_numpy(zero_copy_only=False).tolist()), "<u2", len(words))
        rows = []
        if body:
            rows.append((block, -1, doc_ids, counts.tolist(), len(words), _planes(codes), zstandard.ZstdCompressor(level=1).compress(slices.tobytes())))
        if listed:
            rows += [(block, k, None, None, n, packed, None) for k, n, packed in _words_by_slice(words, slices)]
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
        columns = zip(*rows, strict=True) if rows else ([],) * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for block, held in enumerate(_gathered(batches, BLOCK_BYTES), TaskContext.get().partitionId() << 32):
            yield from flush(held, block)

    schema = "block long, slice int, doc_ids array<long>, counts array<long>, n int, packed binary, slices binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _encode_slices(encoder: Callable[[], Encode]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, known = encoder(), None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("slice", "n", "packed")]
            out = []
            for slice_, n, packed in zip(*columns, strict=True):
                if slice_ != at:  # rows come sorted by slice
                    at, known = slice_, {}
                words = _unpack_words(packed, n)
                new = [w for w in words if w not in known]
                known.update(zip(new, encode(new), strict=True))
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), "<u4", n) // 4
                out.append(_planes(np.concatenate((sizes, np.frombuffer(b"".join(ids), "<u4")))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("slice"), batch.column("n"), pa.array(out, pa.binary())], ["block", "slice", "n", "ids"])

    return run


def _assemble(bodies: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of one block, from their word numbers and the ids of each word."""
    out_ids, out_n, out_bytes = [], [], []
    for body in bodies.select(["doc_ids", "counts", "n", "packed", "slices"]).to_pylist():
        slices = np.frombuffer(zstandard.ZstdDecompressor().decompress(body["slices"]), "<u2")
        by_slice = np.argsort(slices, kind="stable")  # a slice's words came in the order of their numbers
        edges = np.concatenate(([0], np.cumsum(np.bincount(slices, minlength=SLICES))))
        start, size, flat, passed = np.zeros(body["n"], np.int64), np.zeros(body["n"], np.int64), [], 0
        for k, n, packed in zip(*(words[c].to_pylist() for c in ("slice", "n", "ids")), strict=True):
            own = by_slice[edges[k] : edges[k + 1]]
            if len(own) != n:
                raise RuntimeError("the texts changed between two reads; store them first")
            values = _unplanes(packed)
            size[own] = values[:n]
            start[own] = passed + np.cumsum(values[:n], dtype=np.int64) - values[:n]
            flat.append(values[n:])
            passed += len(values) - n
        flat = np.concatenate(flat) if flat else np.zeros(0, "<u4")
        codes = _unplanes(body["packed"])
        per_word = size[codes]
        raw = (flat[_ranges(start[codes], per_word)] if len(codes) else flat[:0]).tobytes()
        edge = np.concatenate(([0], np.cumsum(per_word)))[np.concatenate(([0], np.cumsum(body["counts"], dtype=np.int64)))].tolist()
        out_ids += body["doc_ids"]
        out_n += [b - a for a, b in zip(edge, edge[1:], strict=False)]
        out_bytes += [raw[4 * a : 4 * b] for a, b in zip(edge, edge[1:], strict=False)]
    return pa.table({"doc_id": pa.array(out_ids, pa.int64()), "n_tokens": pa.array(out_n, pa.int64()), "ids": pa.array(out_bytes, pa.binary())})


def encode_corpus(
    docs: DataFrame,
    split: Split,
    spaced: bool,
    encoder: Callable[[], Encode],
    finish: Callable[[pa.Table], pa.Table] | None = None,
    schema: str = "doc_id long, n_tokens long, ids binary",
) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` per row of ``docs``; ``ids`` are little-endian unsigned 32-bit integers.

    ``split`` cuts a unit of text into words that are encoded on their own (a single run of letters
    always is one word); ``encoder`` makes, once in each task, the function that gives the id bytes
    of each of a list of words. The texts are packed once for each side. ``finish`` turns the rows of
    a block into others, of ``schema``, where they are put together. A null text has no ids. Rows are
    not merged.
    """
    small_batches(docs.sparkSession)
    bodies, listed = pack(docs, split, spaced, "body"), pack(docs, split, spaced, "words")
    encoded = (
        listed.select("block", "slice", "n", "packed")
        .repartition("slice")
        .sortWithinPartitions("slice")
        .mapInArrow(_encode_slices(encoder), "block long, slice int, n int, ids binary")
    )

    def put_together(bodies: pa.Table, words: pa.Table) -> pa.Table:
        lean_memory()
        rows = _assemble(bodies, words)
        return rows if finish is None else finish(rows)

    return bodies.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(put_together, schema)


def encode_in_place(
    docs: DataFrame,
    split: Split,
    spaced: bool,
    encoder: Callable[[], Encode],
    finish: Callable[[pa.Table], pa.Table] | None = None,
    schema: str = "doc_id long, n_tokens long, ids binary",
) -> DataFrame:
    """As ``encode_corpus``, in the tasks that read the texts: nothing is shuffled and each text is cut once.

    A task encodes each distinct word of its blocks once, as long as it knows no more than ``KNOWN``
    words. For encoders so fast that a word costs less than its way to another task and back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        encode, known = encoder(), {}
        for held in _gathered(batches, PLACE_BYTES):
            doc_ids, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))
            held.clear()
            words, codes, counts = _pack_block(texts, split, spaced)
            listed = words.to_numpy(zero_copy_only=False).tolist()
            del words, texts
            if len(known) > KNOWN:
                known = {}
            found = list(map(known.get, listed))
            new = [k for k, ids in enumerate(found) if ids is None]
            asked = [listed[k] for k in new]
            for k, word, ids in zip(new, asked, encode(asked), strict=True):
                found[k] = known[word] = ids
            del listed, asked, new
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat = np.frombuffer(b"".join(found), "<u4")
            del found
            per_word = size[codes]
            raw = (flat[_ranges((np.cumsum(size) - size)[codes], per_word)] if len(codes) else flat[:0]).tobytes()
            edge = np.concatenate(([0], np.cumsum(per_word)))[np.concatenate(([0], np.cumsum(counts)))]
            del flat, codes, per_word
            ids = [raw[a:b] for a, b in zip((4 * edge[:-1]).tolist(), (4 * edge[1:]).tolist(), strict=True)]
            rows = pa.table({"doc_id": doc_ids, "n_tokens": pa.array(np.diff(edge), pa.int64()), "ids": pa.array(ids, pa.binary())})
            yield from (rows if finish is None else finish(rows)).to_batches(max_chunksize=1000)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
