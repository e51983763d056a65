"""SimHash near-duplicates: 64-bit fingerprints, a byte-position inverted index, count filtering.

A fingerprint is eight positional bytes. Two fingerprints within ``max_distance`` differing bits
differ in at most that many bytes, so they share at least ``8 - max_distance`` positional bytes:
the guaranteed minimum. A posting list of one (position, byte) holds 1/256 of all fingerprints and
its pairs grow with the square of the corpus, so the index is keyed by groups of positions chosen
such that every pair that reaches the minimum shares at least one whole group (with five of eight
bytes shared, one half of the fingerprint has three of its four: the 8 triples inside the halves).
The pair then tallies all its shared positional bytes, is retained if it reaches the minimum, and
its bit distance is verified.

Equal fingerprints are one node of the index however many documents carry them, so a group of
copies costs one posting per key. Each pair is taken from the first key group it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm.common import landed, small_batches, table, utf8
from subsight.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
#: Shingles whose bits are tallied at a time; bounds the memory a very long text takes.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as a signed 64-bit integer; 0 where there is no word."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    first = np.concatenate(([0], ends[: len(last) - 1] + 1))
    half, ones, digest = len(last) / 2, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(last), BLOCK):
        spans = zip(first[k : k + BLOCK].tolist(), last[k : k + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones > half, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``: one row per row of ``docs``; a null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, words) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def position_groups(max_distance: int) -> list[tuple[int, ...]]:
    """Groups of byte positions such that any ``8 - max_distance`` positions contain a whole group."""
    least = 8 - max_distance
    if not 1 <= least <= 8:
        raise ValueError("max_distance must be between 0 and 7")
    if least == 8:
        return [tuple(range(8))]
    size = 3 if least >= 5 else 2 if least >= 3 else 1
    return sorted(g for half in (range(4), range(4, 8)) for g in combinations(half, size))


def fingerprint_links(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(a, b)``, a < b: every pair of the distinct ``fp`` values within ``max_distance`` bits."""
    groups = position_groups(max_distance)

    def mask(group: tuple[int, ...]) -> int:
        return int(np.array([sum(255 << (8 * p) for p in group)], np.uint64).view(np.int64)[0])

    masks = [mask(g) for g in groups]
    keys = F.array(*[F.struct(F.lit(k).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks)])
    posted = nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.g", "key.v")
    left, right = posted.withColumnRenamed("fp", "a"), posted.withColumnRenamed("fp", "b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    first_group = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)])
    shared = sum((diff.bitwiseAND(F.lit(mask((p,)))) == 0).cast("int") for p in range(8))
    l, r = left.alias("l"), right.alias("r")
    return l.join(
        r,
        (F.col("l.g") == F.col("r.g"))
        & (F.col("l.v") == F.col("r.v"))
        & (F.col("a") < F.col("b"))
        & (shared >= 8 - max_distance)
        & (F.bit_count(diff) <= max_distance)
        & (first_group == F.col("l.g")),
    ).select("a", "b")


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``max_distance``
    differing bits, the row's own included. Null, empty and blank texts have fingerprint 0 and
    link like any other. Repeated rows stay repeated and share their component. A null ``doc_id``
    is never a component's name unless the component has no other id (then it is null). Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    own = landed(fingerprints(docs, words), "fingerprints")
    nodes = own.select("fp").distinct()
    labels = connected_components(fingerprint_links(nodes, max_distance))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    least = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = landed(named.join(least, "fp"), "fingerprint-groups")
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return own.join(named.select("fp", "component").join(low, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` with one document kept of each near-duplicate group: its smallest id.

    Repeated rows of the kept id stay as they are; rows with a null ``doc_id`` can't be named, so
    they are kept too. All columns of ``docs`` are returned unchanged.
    """
    kept = simhash_groups(docs, words, max_distance).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
