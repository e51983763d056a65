"""Incremental line dedup that can be undone: sharded cuckoo filters over exact reference counts.

The state has two tables. ``counts`` has, for each line key of the corpus, the number of documents
that hold it: exact, and the only truth. ``filters`` has a cuckoo filter for each shard of the keys
that are held often enough to be dropped. Documents that come add to the counts, documents that go
take away from them; a key that crosses the threshold is put into its shard's filter or deleted from
it. Deleting documents leads back to the state before they came.

To drop lines, the line keys of the documents meet the filters of their shards, which turn away
nearly all of the others; the few that pass are looked up in the counts.

A key is a line without white space at its ends and with A-Z in lower case, held as its md5 (128 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm.common import landed, table

#: A key in this many documents loses its lines.
MIN_DOCS = 10
#: Keys in a filter when shards are first made, slots in a bucket, moves before a filter counts as full.
SHARD_KEYS, SLOTS, MAX_MOVES = 1 << 16, 4, 500
#: Tasks, at least, over which the lines of one shard are dealt: a single line may be in a third of all documents.
SALTS = 16
BLANKS = " \t\n\x0b\x0c\r"


class State(NamedTuple):
    """``counts``: key binary, n long. ``filters``: shard int, buckets int, slots binary. ``shards``: how many."""

    counts: DataFrame
    filters: DataFrame
    shards: int


# --- cuckoo filter of one shard --------------------------------------------------------------


class Cuckoo:
    """Fingerprints of 16 bits in buckets of four; a key's two buckets follow from each other by the fingerprint.

    All methods take keys as an array of shape (n, 16) of bytes, hash values already.
    """

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, "<u2").reshape(buckets, SLOTS).copy()
        self.mask = buckets - 1  # a power of two

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = keys.view("<u4")
        prints = (words[:, 1] & 0xFFFF).astype(np.uint16)
        prints[prints == 0] = 1  # 0 is an empty slot
        first = (words[:, 2] & self.mask).astype(np.int64)
        return prints, first, first ^ self._step(prints)

    def _step(self, prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(8)).astype(np.int64) & self.mask

    def holds(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return ((self.slots[first] == prints[:, None]) | (self.slots[second] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False: the filter is full, and must be made anew from the counts."""
        for own, first, second in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            if self._put(own, first) or self._put(own, second):
                continue
            at = second
            for move in range(MAX_MOVES):
                slot = (own + move) % SLOTS
                own, self.slots[at, slot] = int(self.slots[at, slot]), own
                at ^= int(self._step(np.array([own], np.uint16))[0])
                if self._put(own, at):
                    break
            else:
                return False
        return True

    def _put(self, own: int, at: int) -> bool:
        free = np.flatnonzero(self.slots[at] == 0)
        if len(free):
            self.slots[at, free[0]] = own
        return len(free) > 0

    def delete(self, keys: np.ndarray) -> None:
        """Take out one copy of each key's fingerprint; keys must have been inserted."""
        for own, first, second in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (first, second):
                found = np.flatnonzero(self.slots[at] == own)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break
            else:
                raise RuntimeError("a key is deleted that the filter never got")


def filter_of(keys: np.ndarray) -> Cuckoo:
    """A filter of ``keys``, filled to at most 80 % (twice as large if that doesn't do)."""
    buckets = 1
    while buckets * SLOTS * 0.8 < len(keys):
        buckets *= 2
    while not (made := Cuckoo(buckets)).insert(keys):
        buckets *= 2
    return made


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


# --- keys and counts ---------------------------------------------------------------------------


def line_keys(text: Column) -> Column:
    """The key of each line of ``text``, in order, as binary; null for an empty key."""

    def key(line: Column) -> Column:
        bare = F.translate(F.trim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.when(bare != "", F.unhex(F.md5(F.encode(bare, "UTF-8"))))

    return F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1), key)


def _with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` stored with a number for each row and its line keys: ``(row, doc_id, text, keys)``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return landed(rows.withColumn("keys", line_keys(F.col("text"))), "line-keys")


def reference_counts(keyed: DataFrame) -> DataFrame:
    """``(key, n)``: in how many rows each key is; counted before the shuffle too."""
    own = keyed.select(F.explode(F.array_distinct("keys")).alias("key"))
    return own.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


FILTER = "shard int, buckets int, slots binary"


def _row(shard: int, cuckoo: Cuckoo, full: bool = False) -> pa.Table:
    slots = None if full else cuckoo.slots.astype("<u2").tobytes()
    return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([len(cuckoo.slots)], pa.int32()), "slots": pa.array([slots], pa.binary())})


def _filled(rows: pa.Table) -> pa.Table:
    return _row(rows["shard"][0].as_py(), filter_of(_keys(rows["key"])))


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", shard_of(F.col("key"), shards))


def build(docs: DataFrame, min_docs: int = MIN_DOCS) -> State:
    """The state of ``docs`` alone."""
    return _build(_with_keys(docs), min_docs)


def _build(keyed: DataFrame, min_docs: int) -> State:
    counts = landed(reference_counts(keyed), "line-counts")
    often = counts.where(F.col("n") >= min_docs)
    shards = 1 + often.count() // SHARD_KEYS
    filters = _sharded(often.select("key"), shards).groupBy("shard").applyInArrow(_filled, FILTER)
    return State(counts, landed(filters, "line-filters"), shards)


def insert(state: State, docs: DataFrame, min_docs: int = MIN_DOCS) -> State:
    """The state with ``docs`` added."""
    return _changed(state, docs, 1, min_docs)


def delete(state: State, docs: DataFrame, min_docs: int = MIN_DOCS) -> State:
    """The state without ``docs``, which must be in it; a count below zero is an error."""
    return _changed(state, docs, -1, min_docs)


def _crossed(filters: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter with keys put in and taken out; a full one comes back without slots."""
    shard = (filters if filters.num_rows else changes)["shard"][0].as_py()
    held = filters.to_pylist()
    cuckoo = Cuckoo(held[0]["buckets"], held[0]["slots"]) if held else Cuckoo(1)
    comes = np.array(changes["comes"].to_pylist(), bool)
    keys = _keys(changes["key"])
    cuckoo.delete(keys[~comes])
    return _row(shard, cuckoo, full=not cuckoo.insert(keys[comes]))


def _changed(state: State, docs: DataFrame, sign: int, min_docs: int) -> State:
    delta = reference_counts(_with_keys(docs)).select("key", F.lit(0).cast("long").alias("was"), (F.col("n") * sign).alias("more"))
    both = state.counts.select("key", F.col("n").alias("was"), F.lit(0).cast("long").alias("more")).unionByName(delta)
    summed = both.groupBy("key").agg(F.sum("was").alias("was"), F.sum("more").alias("more")).withColumn("n", F.col("was") + F.col("more"))
    wrong = F.raise_error(F.lit("documents are deleted that were never inserted")).cast("long")
    summed = landed(summed.withColumn("n", F.when(F.col("n") < 0, wrong).otherwise(F.col("n"))), "line-sums")
    counts = landed(summed.where("n > 0").select("key", "n"), "line-counts")
    before, after = F.col("was") >= min_docs, F.col("n") >= min_docs
    changes = _sharded(summed.where(before != after).select("key", after.alias("comes")), state.shards)
    touched = landed(state.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_crossed, FILTER), "line-filters")
    full = touched.where("slots IS NULL").select("shard")
    again = _sharded(counts.where(F.col("n") >= min_docs).select("key"), state.shards).join(full, "shard", "left_semi")
    filters = touched.where("slots IS NOT NULL").unionByName(again.groupBy("shard").applyInArrow(_filled, FILTER))
    return State(counts, landed(filters, "line-filters"), state.shards)


# --- dropping lines --------------------------------------------------------------------------------


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its filter first: the keys that the filter lets through."""
    at, cuckoo = None, None
    names = ["row", "line", "key"]
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)])).tolist()
        for low, high in zip(edges, edges[1:], strict=False):
            own = batch.slice(low, high - low)
            if not own.num_rows:
                continue
            told = own.filter(pc.is_valid(own.column("slots")))
            if told.num_rows:
                at, cuckoo = int(shards[low]), Cuckoo(told.column("buckets")[0].as_py(), told.column("slots")[0].as_py())
                own = own.filter(pc.is_valid(own.column("key")))
            if at == shards[low] and own.num_rows:  # no filter: the shard has no key to drop
                yield own.filter(pa.array(cuckoo.holds(_keys(own.column("key"))))).select(names)


def marked(keyed: DataFrame, state: State, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(row, dropped)``: the numbers of the lines that go, for rows that lose any."""
    asked = keyed.select("row", F.posexplode("keys").alias("line", "key")).where(F.col("key").isNotNull())
    salts = max(SALTS, -(-int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // state.shards))
    each_salt, own_salt = F.expr(f"explode(sequence(0L, {salts - 1}L)) AS salt"), (F.col("row") % salts).alias("salt")
    asked = _sharded(asked, state.shards).select("shard", own_salt, F.lit(None).cast("int").alias("buckets"), F.lit(None).cast("binary").alias("slots"), "row", "line", "key")
    told = state.filters.select("shard", each_salt, "buckets", "slots", F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("binary").alias("key"))
    passed = (
        asked.unionByName(told)
        .repartition("shard", "salt")
        .sortWithinPartitions("shard", F.col("row").asc_nulls_first())
        .select("shard", "buckets", "slots", "row", "line", "key")
        .mapInArrow(_passing, "row long, line int, key binary")
    )
    often = state.counts.where(F.col("n") >= min_docs).select("key", each_salt)
    return passed.withColumn("salt", own_salt).join(often, ["key", "salt"]).groupBy("row").agg(F.collect_list("line").alias("dropped"))


def _without(text: str | None, dropped: list[int] | None) -> tuple[int, int, str]:
    text = text or ""
    if not dropped:
        return text.count("\n") + 1, 0, text
    lines, out = text.split("\n"), set(dropped)
    return len(lines), len(out), "\n".join([x for k, x in enumerate(lines) if k not in out])


def drop_lines(keyed: DataFrame, state: State, min_docs: int = MIN_DOCS, as_digest: bool = False) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)`` of each row that ``_with_keys`` made; or ``kept_sha256`` for ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_without(t, d) for t, d in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist(), strict=True)]
            kept = [hashlib.sha256(x[2].encode()).hexdigest() if as_digest else x[2] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(kept, pa.string())], names
            )

    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256" if as_digest else "kept"]
    joined = keyed.select("row", "doc_id", "text").join(marked(keyed, state, min_docs), "row", "left")
    return joined.select("doc_id", "text", "dropped").mapInArrow(run, f"doc_id long, n_lines long, n_dropped long, {names[3]} string")


def dedup(docs: DataFrame, state: State | None = None, min_docs: int = MIN_DOCS, as_digest: bool = False) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)``: ``docs`` without the lines whose key is in at least ``min_docs`` documents of ``state`` (default: of ``docs``).

    A null text is one empty line, which stays, as every empty key does. Each row is a document:
    repeated rows and rows without ``doc_id`` count one each, a key that a text holds several times
    counts once. Columns other than ``doc_id`` and ``text`` are not read; an empty table gives an
    empty result.
    """
    keyed = _with_keys(docs)
    return drop_lines(keyed, state or _build(keyed, min_docs), min_docs, as_digest)


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), as_digest=True)


OP13_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
), often AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN often o ON o.key = l.key GROUP BY doc_id
"""
