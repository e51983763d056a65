"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Each tokenizer gives a text as tokens that end at byte offsets. Two dictionaries hold, end to
index, where the tokens of each side end; the ends that both have, sorted, cut both id lists into
groups, and inside each group the overlapping tokens are linked.

The texts of a block are aligned together: both sides cover the same bytes, so one running offset
serves them all. Neither tokenizer joins what stands before a space to what follows it (unless white space stands
before it; a sentencepiece vocabulary is checked for it), so both sides always end at such a place. The parts between are aligned once in each
block of texts, however often they occur, and a text's groups are those of its parts in order.

The links of the corpus are counted by id pair: blocks send the counts of their distinct pairs to
slices of the vocabulary, the slices add them up and send the totals back to the blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, count, pairwise
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm.common import landed, lean_memory, small_batches, table
from subsight.llm.wordcodes import _planes, _unplanes

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"

#: Text bytes gathered into one block (a longer text is a block of its own).
BLOCK_BYTES = 6 << 20
#: Parts encoded and aligned at a time.
PART_CHUNK = 16384
#: Slices of the id pairs, by the B id; their size is bounded by the two vocabularies.
SLICES = 64
#: Blocks whose pairs meet in one task before the totals of a slice are added up.
SALT_BLOCKS = 512

#: White space before a space: no cut there. Python's class holds all that a tokenizer takes for white space.
UNCUT = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")

#: The ids of each of a list of parts (a part is what follows the space it begins with).
Encode = Callable[[list[str]], list[list[int]]]


def parts_of(text: str) -> list[str]:
    """The parts of a space and ``text``, each without the space it begins with."""
    spaced = " " + text
    return [p[1:] for p in CUT.split(spaced)] if UNCUT.search(spaced) else text.split(" ")


def byte_letters() -> dict[int, int]:
    """Byte-level letters: the printable ones of Latin-1 stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {c: c for c in plain} | {256 + k: b for k, b in enumerate(others)}


def tokenizer_a(path: str) -> tuple[Encode, list[bytes]]:
    """Encode with a byte-level tokenizer file, and its token bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters, size = byte_letters(), tokenizer.get_vocab_size()
    known = [tokenizer.id_to_token(k) or "" for k in range(size)]
    held = [t.translate(letters).encode("latin-1") if all(ord(c) in letters for c in t) else t.encode() for t in known]

    def encode(parts: list[str]) -> list[list[int]]:
        out = []
        for low in range(0, len(parts), 4096):
            out += [e.ids for e in tokenizer.encode_batch_fast([" " + p for p in parts[low : low + 4096]], add_special_tokens=False)]
        return out

    return encode, held


def tokenizer_b(path: str) -> tuple[Encode, list[bytes]]:
    """Encode with a sentencepiece model, which adds the space, and its token bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    held = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in range(size)]
    if any(re.search("[^▁]▁", model.id_to_piece(k)) for k in range(size)):
        raise ValueError(f"{path} has pieces that go on past a space")
    space = [model.piece_to_id("▁")]

    def encode(parts: list[str]) -> list[list[int]]:
        # the model adds no space to an empty text
        return [ids if p else space for p, ids in zip(parts, model.encode(parts, num_threads=1), strict=True)]

    return encode, held


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and tokens of B up to each byte offset at which both end, ascending."""
    at_a, at_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
    common = sorted(at_a.keys() & at_b.keys())
    return (np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the tokens whose byte ranges overlap, group by group, in order.

    A group of one token of each side is one link. In any other each end of either side closes a
    stretch of bytes that belongs to one token of A and one of B, and no two stretches to the same two.
    """
    single = (np.diff(to_a, prepend=0) == 1) & (np.diff(to_b, prepend=0) == 1)
    inner_a, inner_b = (np.repeat(~single, np.diff(to, prepend=0)) for to in (to_a, to_b))
    stretch = np.union1d(ends_a[inner_a], ends_b[inner_b])
    a = np.concatenate((to_a[single] - 1, np.searchsorted(ends_a, stretch)))
    b = np.concatenate((to_b[single] - 1, np.searchsorted(ends_b, stretch)))
    order = np.lexsort((b, a))
    return a[order], b[order]


class Aligned(NamedTuple):
    """Consecutive texts or parts aligned: per part its tokens, groups and links, its groups as text, and all links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    shown: list[str]
    links: np.ndarray  # A id below, B id above 32 bits


def align(ids_a: list[list[int]], ids_b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Align parts whose two id lists cover the same bytes; ``size_*`` is a token's number of bytes by id."""
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
    a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    to_a, to_b = common_ends(ends_a.tolist(), ends_b.tolist())
    link_a, link_b = links_of(ends_a, ends_b, to_a, to_b)
    part_to = np.cumsum(n_a)
    n_groups = np.diff(np.searchsorted(to_a, part_to, "right"), prepend=0)
    n_links = np.diff(np.searchsorted(link_a, part_to), prepend=0)
    text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups, i, j = [], 0, 0
    for m, n in zip(to_a.tolist(), to_b.tolist(), strict=True):
        groups.append(f"{text_a[i]}|{text_b[j]}" if m - i == n - j == 1 else ",".join(text_a[i:m]) + "|" + ",".join(text_b[j:n]))
        i, j = m, n
    edge = np.concatenate(([0], np.cumsum(n_groups))).tolist()
    return Aligned(n_a, n_b, n_groups, n_links, [";".join(groups[x:y]) for x, y in pairwise(edge)], b[link_b] << 32 | a[link_a])


class Aligner:
    """Aligns the distinct parts of a block; both vocabularies are loaded once in a task."""

    def __init__(self, path_a: str, path_b: str):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = tokenizer_a(path_a), tokenizer_b(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in held]) for held in (self.bytes_a, self.bytes_b))

    def _spelled(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> bool:
        want = b"".join([b" " + p.encode() for p in parts])
        return all(b"".join(map(held.__getitem__, chain.from_iterable(ids))) == want for held, ids in ((self.bytes_a, a), (self.bytes_b, b)))

    def parts(self, parts: list[str]) -> tuple[np.ndarray, Aligned]:
        """Which of ``parts`` both sides spell byte by byte, and all of them aligned (others as without tokens)."""
        spelled, out = np.ones(len(parts), bool), []
        for low in range(0, len(parts), PART_CHUNK):
            own = parts[low : low + PART_CHUNK]
            a, b = self.encode_a(own), self.encode_b(own)
            if not self._spelled(own, a, b):
                for k, p in enumerate(own):
                    if not self._spelled([p], [a[k]], [b[k]]):
                        spelled[low + k], a[k], b[k] = False, [], []
            out.append(align(a, b, self.size_a, self.size_b))
        joined = [np.concatenate([getattr(x, c) for x in out]) if out else np.zeros(0, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")]
        links = np.concatenate([x.links for x in out]) if out else np.zeros(0, np.int64)
        return spelled, Aligned(*joined, [t for x in out for t in x.shown], links)


def _zstd(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _pack_totals(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted id pairs (A id below, B id above 32 bits) and their counts."""
    return _zstd(np.diff(pairs, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_totals(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(2, 8, -1)
    pairs, counts = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in raw)
    return np.cumsum(pairs), counts


#: A row is a block's documents (slice -1) or what one slice holds of its distinct id pairs.
PACKED = (
    "block long, slice int, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
    "n_parts array<int>, parts binary, n_pairs binary, pairs binary, totals binary"
)


def _pack_block(texts: list[str | None], aligner: Aligner) -> tuple[dict, np.ndarray, np.ndarray]:
    """The documents of a block by their parts, the distinct id pairs of the block and their counts."""
    known: dict[str, int] = {}
    number, listed = known.setdefault, []
    for text in texts:
        own = [number(p, len(known)) for p in parts_of(text)] if text else []
        listed.append(np.array(own, np.int64))
    spelled, aligned = aligner.parts(list(known))
    del known
    listed = [own if spelled[own].all() else own[:0] for own in listed]
    n_parts = np.fromiter(map(len, listed), np.int64, len(listed))
    codes = np.concatenate(listed) if listed else np.zeros(0, np.int64)
    to = np.concatenate(([0], np.cumsum(n_parts)))
    out = {c: np.diff(np.concatenate(([0], np.cumsum(getattr(aligned, c)[codes])))[to]).tolist() for c in ("n_a", "n_b", "n_groups")}
    shown = aligned.shown
    out["digests"] = [hashlib.sha256(";".join([shown[p] for p in own.tolist()]).encode()).hexdigest() if len(own) else "" for own in listed]
    del shown, listed
    pairs, place = np.unique(aligned.links, return_inverse=True)
    times = np.bincount(codes, minlength=len(aligned.n_links))  # a part of texts without tokens counts nothing
    counts = np.bincount(place, weights=np.repeat(times, aligned.n_links), minlength=len(pairs)).astype(np.int64)
    out |= {"n_parts": n_parts.tolist(), "parts": _planes(codes), "n_pairs": _planes(aligned.n_links), "pairs": _planes(place)}
    return out, pairs, counts


def pack(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` aligned part by part: rows of ``PACKED``."""
    names = [f.split()[0] for f in PACKED.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 4]

    def flush(held: list[pa.RecordBatch], block: int, aligner: Aligner) -> pa.RecordBatch:
        body, pairs, counts = _pack_block([t for b in held for t in b.column("text").to_pylist()], aligner)
        body["doc_ids"] = [k for b in held for k in b.column("doc_id").to_pylist()]
        rows, slices = [{"block": block, "slice": -1} | body], (pairs >> 32) % SLICES
        for k in range(SLICES):
            if len(own := np.flatnonzero(slices == k)):
                rows.append({"block": block, "slice": k, "totals": _pack_totals(pairs[own], counts[own])})
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        aligner, held, size, block = None, [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                held.append(batch.slice(low, 128))
                size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
                if size >= BLOCK_BYTES:
                    aligner = aligner or Aligner(path_a, path_b)
                    yield flush(held, block, aligner)
                    held, size, block = [], 0, block + 1
        if held:
            yield flush(held, block, aligner or Aligner(path_a, path_b))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PACKED)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice to one row for each slice, with the totals of its pairs."""
    at, pairs, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_pack_totals(pairs, counts)], pa.binary())], ["slice", "totals"])

    for batch in batches:
        for slice_, packed in zip(batch.column("slice").to_pylist(), batch.column("totals").to_pylist(), strict=True):
            if slice_ != at:
                if at is not None:
                    yield done()
                at, pairs, counts = slice_, pairs[:0], counts[:0]
            more, n = _unpack_totals(packed)
            both, place = np.unique(np.concatenate((pairs, more)), return_inverse=True)
            pairs, counts = both, np.bincount(place, weights=np.concatenate((counts, n)), minlength=len(both)).astype(np.int64)
    if at is not None:
        yield done()


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice, its totals first: for each block's pairs their totals and whether they are their B id's highest."""
    at, pairs, counts, best = None, None, None, None
    for batch in batches:
        out = []
        for block, slice_, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "slice", "totals")), strict=True):
            own, n = _unpack_totals(packed)
            if block is None:
                at, pairs, counts = slice_, own, n
                _, first = np.unique(pairs >> 32, return_index=True)
                best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(pairs)))
            else:
                if at != slice_:
                    raise RuntimeError("a slice without its totals")
                place = np.searchsorted(pairs, own)
                out.append((block, slice_, _zstd(own.tobytes() + counts[place].tobytes() + best[place].astype(np.int64).tobytes())))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["block", "slice", "totals"])


def pair_totals(packed: DataFrame, salts: int = 1) -> DataFrame:
    """``(slice, totals)``: the links of the corpus by id pair. Blocks are added up by salt first, then the salts."""
    rows = packed.where("slice >= 0").select("slice", (F.col("block") % salts).alias("salt"), "totals")
    first = rows.repartition("slice", "salt").sortWithinPartitions("slice", "salt").select("slice", "totals").mapInArrow(_add_up, "slice int, totals binary")
    return first.repartition("slice").sortWithinPartitions("slice").mapInArrow(_add_up, "slice int, totals binary")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(bodies: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block, from the totals of its id pairs."""
    lean_memory()
    told = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8").reshape(3, -1) for x in answers["totals"].to_pylist()]
    told = np.concatenate(told, axis=1) if told else np.zeros((3, 0), np.int64)
    _, total, best = told[:, np.argsort(told[0])]  # in the order of the block's pairs
    out = []
    for body in bodies.to_pylist():
        codes, n_pairs, place = (_unplanes(body[c]) for c in ("parts", "n_pairs", "pairs"))
        edge = np.concatenate(([0], np.cumsum(n_pairs, dtype=np.int64)))

        def by_part(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(values[place])))[edge])[codes]

        to = np.concatenate(([0], np.cumsum(body["n_parts"], dtype=np.int64)))
        n_links, n_best, count_sum = (np.diff(np.concatenate(([0], np.cumsum(by_part(v))))[to]) for v in (np.ones_like(total), best, total))
        out.append(pa.table([pa.array(c) for c in (body["doc_ids"], body["n_a"], body["n_b"], body["n_groups"], n_links, n_best, count_sum, body["digests"])], [f.split()[0] for f in RESULT.split(", ")]))
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in RESULT.split(", ")])
    return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row of ``RESULT`` for each row of ``docs``.

    ``n_links`` counts overlapping token pairs; ``n_best`` those whose id pair is linked most often
    in the corpus for its B id (ties included); ``count_sum`` adds the corpus counts of all links.
    A null or empty text, and one that the tokens of a side don't spell byte by byte, has zeros, an
    empty ``groups_sha256`` and no part in the counts. Repeated rows and rows without ``doc_id``
    count like any other; other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    packed = landed(pack(docs, path_a, path_b), "aligned")
    salts = 1 + packed.where("slice < 0").count() // SALT_BLOCKS
    totals = landed(pair_totals(packed, salts), "pair-totals")
    asked = packed.where("slice >= 0").select("block", "slice", (F.col("block") % salts).alias("salt"), "totals")
    told = totals.select(F.lit(None).cast("long").alias("block"), "slice", F.expr(f"explode(sequence(0L, {salts - 1}L)) AS salt"), "totals")
    answers = (
        asked.unionByName(told)
        .repartition("slice", "salt")
        .sortWithinPartitions("slice", "salt", F.col("block").asc_nulls_first())
        .select("block", "slice", "totals")
        .mapInArrow(_answer, "block long, slice int, totals binary")
    )
    return packed.where("slice < 0").drop("slice", "totals").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish, RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B))
