"""Removal of repeated byte strings, by suffix arrays over what can repeat at all.

A byte is removed if it is covered by a string of ``length`` bytes (a window) that also starts in a
document with a smaller id. Four steps, each a Spark shuffle; matches never cross documents:

1. Every window is owned by its least-hashed gram (an anchor). Equal windows have equal anchors at
   the same place, so windows of anchors that stand nowhere else cannot repeat. An anchor's windows
   lie next to each other; their text is its span.
2. Anchors of all blocks of text are grouped by gram. Where all spans of a gram are equal, they
   repeat as a whole: the smallest id keeps its bytes. Nothing more is looked at there.
3. The other spans are cut in pieces that are dealt out by the content that all equal windows
   share. Equal pieces of a deal are one text. The windows of a deal of several texts are classed by
   a suffix array made with the difference-cover algorithm (``suffix_array``): equal windows are
   adjacent and share their prefix. Each class gives the smallest id that has it.
4. The blocks get both answers back and cut the bytes out of their texts.

A gram or piece that very many places share is neither collected in one task nor capped: copies are
merged in their block, and deals too large for one suffix array are classed by grouping windows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm.common import landed, lean_memory, small_batches, spare_name, table
from subsight.llm.suffix_array import equal_prefixes

LENGTH = 50
GRAM = 24
#: Text bytes in a block; window starts worked on at a time.
BLOCK_BYTES, SEGMENT = 3 << 20, 1 << 18
#: Text bytes of which one task groups the grams, about.
SLICE_BYTES = 2 << 20
#: Spans of one gram in a block above which they all go to step 3.
MANY = 64
#: Text bytes in a suffix array; pieces of a deal above which windows are grouped instead.
ARRAY_BYTES, HOT = 1 << 20, 8192
#: The id that stands for a null doc_id: larger than any other.
NO_ID = (1 << 63) - 1

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out, reach = len(x) - width + 1, x, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[:size], out[width - reach : width - reach + size])


@dataclass
class Anchors:
    """The anchors of a block: gram and span hashes, place of the gram, first and last window, document."""

    gram: np.ndarray
    span: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


def find_anchors(text: np.ndarray, edges: np.ndarray, length: int = LENGTH) -> Anchors:
    """``text`` is the bytes of a block's documents one after the other, ``edges`` where each begins, and the end."""
    width, parts = length - GRAM + 1, []
    values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    powers, inverses = _powers(_BASE, SEGMENT + length), _powers(_INVERSE, SEGMENT + length)
    for begin in range(0, max(0, len(text) - length + 1), SEGMENT):
        own = text[begin : begin + SEGMENT + length - 1]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[own] * powers[: len(own)])))
        gram = _mix((sums[GRAM:] - sums[:-GRAM]) * inverses[: len(own) - GRAM + 1])
        order = gram >> np.uint64(24) << np.uint64(24) | np.arange(len(gram), dtype=np.uint64)
        owner = (_sliding_min(order, width) & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.arange(len(owner))
        doc = np.searchsorted(edges, begin + starts, "right") - 1
        starts = starts[begin + starts + length <= edges[doc + 1]]
        if not len(starts):
            continue
        owner, doc = owner[starts], doc[starts]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(starts) != 1))))
        last = np.concatenate((first[1:], [len(starts)])) - 1
        at, low, high = owner[first], starts[first], starts[last]
        spans = (sums[high + length] - sums[low]) * inverses[low]
        spans = _mix(spans + _mix((at - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)))
        parts.append((gram[at], spans, at + begin, low + begin, high + begin, doc[first]))
    if not parts:
        empty = np.zeros(0, np.int64)
        return Anchors(empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty)
    return Anchors(*(np.concatenate(p) for p in zip(*parts, strict=True)))


@dataclass
class Block:
    """A block's rows in the order of their ids, and its text. The last two columns are the id and the text."""

    rows: pa.Table
    ids: np.ndarray
    text: np.ndarray
    edges: np.ndarray

    @classmethod
    def unpack(cls, packed: bytes) -> Block:
        return cls.of(pa.ipc.open_stream(io.BytesIO(zstandard.ZstdDecompressor().decompress(packed))).read_all())

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        ids = pc.fill_null(rows.column(rows.num_columns - 2), NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = rows.take(pa.array(order))
        texts = [t or b"" for t in rows.column(rows.num_columns - 1).cast(pa.binary()).to_pylist()]
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        return cls(rows, ids[order], np.frombuffer(b"".join(texts), np.uint8), edges)


@dataclass
class Entries:
    """The different (gram, span) pairs of a block in the order of gram, and which pair each anchor has."""

    gram: np.ndarray
    span: np.ndarray
    doc: np.ndarray
    of: np.ndarray


def make_entries(a: Anchors) -> Entries:
    """``doc`` is the first, and so the smallest, document that has the pair."""
    both = a.gram ^ _mix(a.span)
    _, first, of = np.unique(both, return_index=True, return_inverse=True)
    order = np.lexsort((a.span[first], a.gram[first]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = first[order]
    return Entries(a.gram[first], a.span[first], a.doc[first], place[of])


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))), [len(sorted_keys)])) if len(sorted_keys) else np.zeros(1, np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as byte planes, compressed."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unsqueeze(packed: bytes, n: int, *types: str) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8), [], 0
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(t))
        at += n * size
    return out


#: What is known of an entry: a smaller id has it all; no smaller id has it; its windows must be looked at.
ELSEWHERE, FIRST_HERE, LOOK = 1, 2, 3


def others_of(docs: DataFrame, text: str = "text") -> list[str]:
    return [c for c in docs.columns if c != text]


def _with_id_and_text(docs: DataFrame, others: list[str]) -> DataFrame:
    return docs.select(*[docs[c] for c in others], docs["doc_id"].cast("long").alias(spare_name(others, "id")), docs["text"].cast("string").alias("text"))


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """``(number, rows)`` of each block; the numbers come from the partition and the order in it."""
    held, size, number, seen = [], 0, TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        low = 0
        while low < batch.num_rows:  # cut at every 128 rows of the partition, wherever its batches end
            piece = batch.slice(low, 128 - seen % 128)
            low, seen = low + piece.num_rows, seen + piece.num_rows
            held.append(piece)
            size += pc.sum(pc.binary_length(piece.column(piece.num_columns - 1))).as_py() or 0
            if size >= BLOCK_BYTES and seen % 128 == 0:
                yield number, pa.Table.from_batches(held)
                held, size, number = [], 0, number + 1
    if held:
        yield number, pa.Table.from_batches(held)


def pack_blocks(docs: DataFrame) -> DataFrame:
    """``(block, packed)``: the rows of ``docs`` with all their columns, many to a block.

    The blocks are made again for each step: ``docs`` must be a read that gives the same rows
    again, as a stored table is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for number, rows in _cut_blocks(batches):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows)
            packed = zstandard.ZstdCompressor(level=1).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed], pa.binary())], ["block", "packed"])

    return _with_id_and_text(docs, others_of(docs)).mapInArrow(run, "block long, packed binary")


def gram_entries(docs: DataFrame, slices: int, length: int = LENGTH) -> DataFrame:
    """``(block, slice, n, ids, packed)``: the entries of every block, by the leading bits of the gram."""
    shift = np.uint64(64 - (slices - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for number, rows in _cut_blocks(batches):
            block = Block.of(rows)
            e = make_entries(find_anchors(block.text, block.edges, length))
            edges = _groups(e.gram)
            crowded = np.repeat(np.diff(edges) > MANY, np.diff(edges))
            rows, cut = [], np.searchsorted(e.gram >> shift, np.arange(slices + 1, dtype=np.uint64)) if slices > 1 else np.array([0, len(e.gram)])
            for k in range(slices):
                s = slice(cut[k], cut[k + 1])
                if s.stop == s.start:
                    continue
                # a crowded gram is sent as two spans that nobody else has: all its spans are to be looked at
                keep = ~crowded[s]
                marks = np.unique(e.gram[s][~keep])
                gram = np.concatenate((e.gram[s][keep], np.repeat(marks, 2)))
                span = np.concatenate((e.span[s][keep], np.tile(np.arange(2, dtype=np.uint64) + np.uint64(number & _MASK), len(marks))))
                doc = np.concatenate((e.doc[s][keep], np.zeros(2 * len(marks), np.int64)))
                used, doc = np.unique(doc, return_inverse=True)
                rows.append((number, k, len(gram), _squeeze(block.ids[used]), len(used), _squeeze(gram, span, doc.astype("<u4"))))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "slice", "n", "ids", "m", "packed"])

    return _with_id_and_text(docs, []).mapInArrow(run, "block long, slice int, n int, ids binary, m int, packed binary")


def _judge_slice(rows: pa.Table) -> pa.Table:
    """``(block, slice, n, codes)``: what is known of each entry that a block has sent."""
    lean_memory()
    parts = [(block, n, _unsqueeze(packed, n, "<u8", "<u8", "<u4"), _unsqueeze(ids, m, "<i8")[0]) for block, n, ids, m, packed in zip(*(rows[c].to_pylist() for c in ("block", "n", "ids", "m", "packed")), strict=True)]
    gram, span = (np.concatenate([p[2][k] for p in parts]) for k in (0, 1))
    ids = np.concatenate([p[3][p[2][2]] for p in parts])
    order = np.lexsort((span, gram))
    edges = _groups(gram[order])
    sizes = np.diff(edges)
    low, high = span[order][edges[:-1]], span[order][edges[1:] - 1]
    least = np.minimum.reduceat(ids[order], edges[:-1])
    codes = np.empty(len(gram), np.uint8)
    codes[order] = np.where(np.repeat(low != high, sizes), LOOK, np.where(ids[order] > np.repeat(least, sizes), ELSEWHERE, FIRST_HERE))
    cuts = np.concatenate(([0], np.cumsum([p[1] for p in parts])))
    packed = [zstandard.ZstdCompressor(level=1).compress(codes[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": pa.array([p[0] for p in parts], pa.int64()), "slice": rows["slice"], "codes": pa.array(packed, pa.binary())})


def entry_codes(e: Entries, slices: int, answers: dict[int, bytes]) -> np.ndarray:
    """The codes of the block's entries; those of crowded grams were not sent one by one."""
    shift = np.uint64(64 - (slices - 1).bit_length())
    edges = _groups(e.gram)
    crowded = np.repeat(np.diff(edges) > MANY, np.diff(edges))
    codes = np.full(len(e.gram), LOOK, np.uint8)
    cut = np.searchsorted(e.gram >> shift, np.arange(slices + 1, dtype=np.uint64)) if slices > 1 else np.array([0, len(e.gram)])
    for k in range(slices):
        own = np.arange(cut[k], cut[k + 1])
        if len(own):
            own = own[~crowded[own]]
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(answers[k]), np.uint8) if k in answers else ()
            if len(got) < len(own):
                raise RuntimeError("the texts changed between two reads; store them first")
            codes[own] = got[: len(own)]
    return codes


@dataclass
class Pieces:
    """Pieces of the spans that must be looked at: first and last window, deal, smallest document.

    ``of`` has the piece of each place in the block where one stands, ``anchor`` and ``begin`` its
    anchor and first window.
    """

    low: np.ndarray
    high: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray
    begin: np.ndarray
    of: np.ndarray


def make_pieces(text: np.ndarray, a: Anchors, look: np.ndarray, length: int = LENGTH) -> Pieces:
    """The windows that begin up to ``half`` bytes before their gram share what stands after it, the others what stands before it."""
    half = (length - GRAM) // 2
    right = length - half  # bytes from the gram on that all of the first kind have
    at = np.flatnonzero(look)
    near = np.stack((np.maximum(a.low[at], a.at[at] - half), a.high[at], a.at[at], np.full(len(at), right)))
    far = np.stack((a.low[at], np.minimum(a.high[at], a.at[at] - half - 1), a.at[at] - half - 1, np.full(len(at), half + 1 + GRAM)))
    both, anchor = np.concatenate((near, far), axis=1), np.concatenate((at, at))
    side = np.repeat(np.array([0, 1]), len(at))
    real = both[0] <= both[1]
    (low, high, begin, size), anchor, side = both[:, real], anchor[real], side[real]
    if not len(low):
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none, none, none, none)
    key, whole = _hash_ranges(text, begin, size), _hash_ranges(text, low, high - low + length)
    key = _mix(key + side.astype(np.uint64))
    same = _mix(whole ^ _mix(key + (begin - low).astype(np.uint64)))
    _, first, of = np.unique(same, return_index=True, return_inverse=True)
    doc = np.full(len(first), len(a.doc) and a.doc.max() + 1)
    np.minimum.at(doc, of, a.doc[anchor])
    return Pieces(low[first], high[first], key[first].view(np.int64), doc, anchor, low, of)


def _hash_ranges(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of short ranges of the text."""
    values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    out, most = size.astype(np.uint64), int(size.max())
    for k in range(most):
        more = size > k
        out[more] = out[more] * np.uint64(_BASE) + values[text[begin[more] + k]]
    return _mix(out)


def unsettled_pieces(blocks: DataFrame, codes: DataFrame, slices: int, length: int = LENGTH) -> DataFrame:
    """``(block, piece, key, doc, text)``: the pieces that must be looked at, each once in its block."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        lean_memory()
        rows = []
        for number, packed in zip(blocks["block"].to_pylist(), blocks["packed"].to_pylist(), strict=True):
            block = Block.unpack(packed)
            a = find_anchors(block.text, block.edges, length)
            e = make_entries(a)
            known = entry_codes(e, slices, dict(zip(answers["slice"].to_pylist(), answers["codes"].to_pylist(), strict=True)))
            p = make_pieces(block.text, a, known[e.of] == LOOK, length)
            raw = block.text.tobytes()
            texts = [raw[i : j + length] for i, j in zip(p.low.tolist(), p.high.tolist(), strict=True)]
            rows.append(pa.table({"block": pa.array(np.full(len(texts), number)), "piece": pa.array(np.arange(len(texts), dtype=np.int32)), "key": pa.array(p.key), "doc": pa.array(block.ids[p.doc]), "text": pa.array(texts, pa.binary())}))
        return pa.concat_tables(rows) if rows else pa.table({n: pa.array([], t) for n, t in (("block", pa.int64()), ("piece", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("text", pa.binary()))})

    return blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(run, "block long, piece int, key long, doc long, text binary")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(edges, data)`` of a binary array without nulls: where each value begins in the data, and the end."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return edges - edges[0], np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of every range, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def class_windows(texts: pa.Array, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The smallest document of the class of each window of each text in turn, by a suffix array of all texts."""
    edges, joined = _bytes_of(texts)
    windows = np.diff(edges) - length + 1
    number = equal_prefixes(joined, _spread(edges[:-1], windows), length)
    least = np.full(number.max() + 1, NO_ID)
    np.minimum.at(least, number, np.repeat(docs, windows))
    return least[number]


def class_deals(key: np.ndarray, doc: np.ndarray, text: pa.Array, length: int = LENGTH) -> pa.Array:
    """Per piece the smallest documents of its windows' classes. Equal keys lie next to each other.

    Equal pieces are one text with the smallest of their documents. Where all pieces of a deal are
    equal, that document is the answer for every window; the other texts go into a suffix array.
    """
    coded = text.dictionary_encode()
    of, texts = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    first = np.full(len(texts), NO_ID)
    np.minimum.at(first, of, doc)
    deal = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    pairs = np.unique(deal * len(texts) + of)
    mixed = np.zeros(len(texts), bool)
    mixed[pairs[(np.bincount(pairs // len(texts)) > 1)[pairs // len(texts)]] % len(texts)] = True
    windows = np.diff(_bytes_of(texts)[0]) - length + 1
    least = np.repeat(first, windows)
    if mixed.any():
        least[np.repeat(mixed, windows)] = class_windows(texts.filter(pa.array(mixed)), first[mixed], length)
    begins, sizes = np.cumsum(windows) - windows, windows[of]
    data = least[_spread(begins[of], sizes)].astype("<i8")
    edges = np.concatenate(([0], 8 * np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _class_deals(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            key, doc = rows["key"].to_numpy(), rows["doc"].to_numpy()
            least = class_deals(key, doc, rows["text"].chunk(0).cast(pa.binary()), length)
            window = pa.array(np.zeros(len(key), np.int32))
            return pa.RecordBatch.from_arrays([rows["block"].chunk(0), rows["piece"].chunk(0), window, least], ["block", "piece", "window", "least"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if size >= ARRAY_BYTES:  # rows come sorted by deal, and a deal is not cut
                rows = pa.Table.from_batches(held)
                other = np.flatnonzero(rows["key"].to_numpy() != rows["key"][-1].as_py())
                if len(other):
                    yield flush(rows.slice(0, other[-1] + 1))
                    held = rows.slice(other[-1] + 1).to_batches()
                    size = sum(pc.sum(pc.binary_length(b.column("text"))).as_py() or 0 for b in held)
        if size:
            yield flush(pa.Table.from_batches(held))

    return run


def settle(pieces: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``(block, piece, window, least)``: the smallest ids of the classes of a piece's windows, from ``window`` on."""
    crowded = landed(pieces.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "hot-deals")
    schema = "block long, piece int, window int, least binary"
    usual, large = pieces, None
    if not crowded.isEmpty():
        usual = pieces.join(crowded, "key", "left_anti").select("block", "piece", "key", "doc", "text")
        windows = pieces.join(crowded, "key").select(
            "block", "piece", "doc", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text") - length + 1), lambda k: F.substring("text", k, F.lit(length)))).alias("window", "text")
        )
        windows = landed(windows, "hot-windows")
        least = windows.groupBy("text").agg(F.min("doc").alias("least"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed = [np.array([x], "<i8").tobytes() for x in batch.column("least").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], batch.schema.names)

        large = windows.join(least, "text").select("block", "piece", "window", "least").mapInArrow(pack, schema)
    dealt = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_class_deals(length), schema)
    return dealt if large is None else dealt.unionByName(large)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, as_text: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with what is left of each text, and the names of the new columns.

    The new columns are ``n_bytes`` (of the text), ``n_removed``, ``n_spans`` (maximal removed runs),
    and ``kept`` (the remaining bytes in order; with ``as_text`` as a string, without what a cut
    left of a character); where ``docs`` has such a column, the name gets a
    number. A null text has no bytes, and texts shorter than ``length`` lose nothing. Rows with the
    same ``doc_id`` are the same document: what they share alone stays. A null ``doc_id`` counts as
    larger than any other, and rows with it as one document. Repeats within a document stay. An
    empty table gives an empty result. ``docs`` is read three times and must give the same rows.
    """
    if not GRAM + 8 <= length <= 64:
        raise ValueError(f"length must be from {GRAM + 8} to 64")
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 << max(0, (-(-total // SLICE_BYTES) - 1).bit_length())
    blocks = pack_blocks(docs)
    judged = gram_entries(docs, slices, length).groupBy("slice").applyInArrow(_judge_slice, "block long, slice int, codes binary")
    codes = landed(judged, "gram-codes")
    pieces = landed(unsettled_pieces(blocks, codes, slices, length), "pieces")
    settled = settle(pieces, length, hot)
    nothing = F.lit(None).cast("binary")
    answers = codes.select("block", "slice", "codes", F.lit(0).alias("window"), nothing.alias("least")).unionByName(
        settled.select("block", F.col("piece").alias("slice"), nothing.alias("codes"), "window", "least")
    )
    names = {n: spare_name(docs.columns, n) for n in ("n_bytes", "n_removed", "n_spans", "kept")}
    columns = docs.columns

    def cut(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        lean_memory()
        out = []
        for packed in blocks["packed"].to_pylist():
            block = Block.unpack(packed)
            a = find_anchors(block.text, block.edges, length)
            e = make_entries(a)
            of_slice = answers.filter(pc.is_valid(answers["codes"]))
            known = entry_codes(e, slices, dict(zip(of_slice["slice"].to_pylist(), of_slice["codes"].to_pylist(), strict=True)))[e.of]
            ids = block.ids[a.doc]
            # the entry's smallest document here is the smallest of all where the code says so
            gone = (known == ELSEWHERE) | ((known == FIRST_HERE) & (ids > block.ids[e.doc[e.of]]))
            depth = np.zeros(len(block.text) + 1, np.int32)
            np.add.at(depth, a.low[gone], 1)
            np.add.at(depth, a.high[gone] + length, -1)
            p = make_pieces(block.text, a, known == LOOK, length)
            if len(p.low):
                of_piece = answers.filter(pc.is_valid(answers["least"]))
                windows = p.high - p.low + 1
                offset = np.cumsum(windows) - windows
                least = np.full(windows.sum(), NO_ID)
                edges, raw = _bytes_of(of_piece["least"].combine_chunks().cast(pa.binary()))
                count = np.diff(edges) // 8
                begin = offset[of_piece["slice"].to_numpy()] + of_piece["window"].to_numpy()
                if count.sum() != len(least):
                    raise RuntimeError("the texts changed between two reads; store them first")
                least[_spread(begin, count)] = raw.view("<i8")
                each = windows[p.of]
                nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                smaller = least[np.repeat(offset[p.of], each) + nth] < np.repeat(block.ids[a.doc[p.anchor]], each)
                begins = (np.repeat(p.begin, each) + nth)[smaller]
                np.add.at(depth, begins, 1)
                np.add.at(depth, begins + length, -1)
            removed = np.cumsum(depth[:-1]) > 0
            out.append(_result(block, removed, columns, names, as_text))
        return pa.concat_tables(out)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{names[n]}` {t}" for n, t in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "string" if as_text else "binary"))]
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, ", ".join(fields)), names


def _result(block: Block, removed: np.ndarray, columns: list[str], names: dict[str, str], as_text: bool) -> pa.Table:
    sums = np.concatenate(([0], np.cumsum(removed)))
    begins = removed & ~np.concatenate(([False], removed[:-1])) if len(removed) else removed
    begins[block.edges[:-1][block.edges[:-1] < len(removed)]] |= removed[block.edges[:-1][block.edges[:-1] < len(removed)]]
    spans = np.concatenate(([0], np.cumsum(begins)))
    left, lefts = block.text[~removed].tobytes(), np.concatenate(([0], np.cumsum(~removed)))[block.edges].tolist()
    kept = [left[i:j] for i, j in zip(lefts, lefts[1:], strict=False)]
    others = iter(range(len(columns)))
    cells = [block.rows.column(block.rows.num_columns - 1 if c == "text" else next(others)) for c in columns]
    new = {
        "n_bytes": pa.array(np.diff(block.edges)),
        "n_removed": pa.array(np.diff(sums[block.edges])),
        "n_spans": pa.array(np.diff(spans[block.edges])),
        "kept": pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
    }
    return pa.table([*cells, *new.values()], names=[*columns, *(names[n] for n in new)])


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
