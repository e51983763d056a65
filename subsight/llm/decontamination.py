"""Benchmark decontamination by pigeonhole edit matching.

An item occurs in a text if some passage of the text is within the item's error budget of edits
(insertions, deletions, substitutions of characters). The item is cut into budget + 1 pieces: at
least one piece of an occurrence is free of errors. An automaton finds the exact hits of all pieces
in one pass over each whole text, and the surroundings of each hit are verified by Myers'
bit-parallel edit distance (Myers, 1999), with the whole item in one integer.

Items are sent to the tasks in blocks of bounded size; each block is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm.common import shared, table

#: Characters of an item for each edit allowed.
CHARS_PER_EDIT = 20
#: Characters of items in a block: what is broadcast at a time.
BLOCK_CHARS = 4 << 20


def normalised(text: str | None) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``(offset, piece)``: the item cut into ``edits + 1`` pieces as equal as can be."""
    edges = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(pattern_masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """``(edits, end)`` of the best end of an occurrence of the pattern in ``text``, the first of equals; None above ``most``.

    ``pattern_masks`` has the bit set of each character's places in the pattern of length ``m``.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for end, c in enumerate(text, 1):
        eq = pattern_masks.get(c, 0)
        xv, xh = eq | minus, (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & full), plus & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full, mh << 1 & full  # no cost for text before the occurrence
        plus, minus = mh | (~(xv | ph) & full), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


class Items:
    """A block of items ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(key, text, budget(text)) for key, text in ((k, normalised(t)) for k, t in items) if text]
        self.masks: list[dict[str, int]] = []
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(self.items):
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks.append(masks)
            for offset, piece in pieces(text, edits):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item, edits, budget, end)`` of every item that occurs in the whole text; ``end`` is in the normalised text."""
        text = normalised(text)
        if not self.items or not text:
            return []
        areas: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                _, item, edits = self.items[k]
                start = last + 1 - size - offset
                low, high = max(0, start - edits), min(len(text), start + len(item) + edits)
                own = areas.setdefault(k, [])
                if own and low <= own[-1][1]:  # hits come in the order of their ends; areas that meet are one
                    own[-1] = [min(low, own[-1][0]), max(high, own[-1][1])]
                else:
                    own.append([low, high])
        out = []
        for k, own in areas.items():
            key, item, edits = self.items[k]
            best = None
            for low, high in own:
                got = (0, text.index(item, low, high) - low + len(item)) if item in text[low:high] else myers(self.masks[k], len(item), text[low:high], edits)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], got[1] + low)
            if best:
                out.append((key, best[0], edits, best[1]))
        return out


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters by a hash of their ids."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if total <= block_chars else -(-2 * total // block_chars)
    own = items.where(F.col("text").isNotNull()).select("item_id", "text")
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        if rows:
            yield sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def benchmark_matches(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, edits, budget, end_char)`` for every row of ``docs`` and item that occurs in it.

    ``edits`` are the fewest of all its occurrences, ``end_char`` where the first such one ends in the
    normalised text. Null, empty and blank texts and items match nothing. Repeated rows of either
    table give repeated rows; ids may be null. Columns other than the ids and texts are not read. An
    empty table gives an empty result.
    """
    schema = "doc_id long, item_id long, edits int, budget int, end_char long"
    texts = docs.select(F.col("doc_id").cast("long"), "text")

    def search(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(block())
            for batch in batches:
                pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                rows = [(doc, *found) for doc, text in pairs for found in items.search(text)]
                columns = zip(*rows, strict=True) if rows else ([],) * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "edits", "budget", "end_char"])

        return texts.mapInArrow(run, schema)

    out = None
    for block in _blocks(items, block_chars):
        part = search(shared(docs.sparkSession, block))
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_benchmark(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns; the texts are not shuffled."""
    out = docs
    for rows in _blocks(items, block_chars):
        block = shared(docs.sparkSession, rows)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block())
            for batch in batches:
                yield batch.filter(pa.array([not items.search(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
