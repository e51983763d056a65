"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs.

A word's input is its own evidence and embedding together with those of its character n-grams, so
unseen forms of a known stem are recognised. Evidence is the smoothed log-odds of a feature among
all labelled rows (counted by Spark over their whole texts); embeddings and the network are
trained in numpy on a bounded sample of windows of labelled rows. A document's score is the highest
of all its overlapping windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm import gru
from subsight.llm.common import give_back, lean_memory, shared, small_batches, table, utf8
from subsight.llm.langid import remainder

#: Words per window, and words from one window's start to the next.
STEPS, STRIDE = 32, 16
#: Hash buckets of words and of character n-grams; sizes of the n-grams (the word's ends count as a character).
WORD_BUCKETS = NGRAM_BUCKETS = 1 << 18
NGRAMS = (4, 5, 6, 8)
#: Embedding buckets and widths; hidden units in each direction; attention units.
EMBEDDED, WIDTH, HIDDEN, ATTENTION = 1 << 13, 3, 6, 6
#: Labelled rows of each label whose windows the network is trained on (a bound on the fit alone).
SAMPLE = 1500
THRESHOLD = 0.7
#: Text bytes and windows worked on at a time.
BLOCK_BYTES, WINDOWS = 4 << 20, 4096
#: Distinct words of a block whose n-grams are held at a time.
WORDS = 1 << 12

#: ASCII letters in lower case; digits and other ASCII as a space; bytes of other characters as they are.
FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def split_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as numbers into them, and the number of words of each text."""
    folded = pa.array([(t or b"").translate(FOLD) for t in texts], pa.large_binary()).cast(pa.large_string())
    parts = pc.ascii_split_whitespace(folded)
    coded = parts.values.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    offsets = np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py()
    real = np.fromiter((bool(w) for w in words), bool, len(words))[at] if len(at) else np.zeros(0, bool)
    passed = np.concatenate(([0], np.cumsum(real)))
    return words, at[real], np.diff(passed[offsets])


@dataclass
class WordFeatures:
    """Hashed features of a list of words: two buckets for the word and for each of its n-grams.

    ``word`` and ``grams`` (flat, ``sizes`` per word) have one row per hash function. What is known
    of a feature is the lesser of its two buckets, so an unseen feature that shares a bucket with a
    telling one is not taken for it.
    """

    word: np.ndarray
    grams: np.ndarray
    sizes: np.ndarray

    def spread(self, words: np.ndarray) -> np.ndarray:
        """Where the n-grams of ``words`` are in ``grams``."""
        sizes = self.sizes[words]
        return np.repeat((np.cumsum(self.sizes) - self.sizes)[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def of(self, words: np.ndarray, half: np.ndarray | int = 0) -> WordFeatures:
        """The features of some of the words, in the second half of the tables where ``half`` is 1."""
        gram_half = np.repeat(half, self.sizes[words]) if isinstance(half, np.ndarray) else half
        return WordFeatures(self.word[:, words] + half * WORD_BUCKETS, self.grams[:, self.spread(words)] + gram_half * NGRAM_BUCKETS, self.sizes[words])


def word_features(words: list[bytes]) -> WordFeatures:
    padded, lengths = _padded(words)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(padded))
    rolled, grams, owners = np.zeros(len(padded), np.uint32), [], []
    with np.errstate(over="ignore"):
        for i in range(max(NGRAMS)):
            rolled = rolled * np.uint32(0x01000193) ^ np.concatenate((padded[i:], np.zeros(min(i, len(padded)), np.uint32)))
            if i + 1 in NGRAMS:
                fits = room >= i + 1
                grams.append(_two_buckets(rolled[fits], NGRAM_BUCKETS))
                owners.append(owner[fits])
    owners, grams = np.concatenate(owners), np.concatenate(grams, axis=1)
    order = np.argsort(owners, kind="stable")
    return WordFeatures(word_buckets(words), grams[:, order], np.bincount(owners, minlength=len(words)))


def word_buckets(words: list[bytes]) -> np.ndarray:
    """The two buckets of every word, without its n-grams."""
    if not words:
        return np.zeros((2, 0), np.int64)
    padded, lengths = _padded(words)
    starts = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        place = np.arange(len(padded)) - np.repeat(starts, lengths)
        salted = (padded + np.uint32(1)) * (place.astype(np.uint32) * np.uint32(2654435761) + np.uint32(0x9E3779B1))
        salted = (salted ^ salted >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        return _two_buckets(np.add.reduceat(salted, starts, dtype=np.uint32), WORD_BUCKETS)


def features_in_turn(words: list[bytes]) -> Iterator[tuple[slice, WordFeatures]]:
    """The features of ``WORDS`` words at a time: a word has some dozens of n-grams, and a block very many words."""
    for k in range(0, len(words), WORDS):
        yield slice(k, k + WORDS), word_features(words[k : k + WORDS])


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all words with their ends, and how many each word has."""
    padded = np.frombuffer(b"".join(b"^" + w + b"$$$" for w in words), np.uint8).astype(np.uint32)
    return padded, np.fromiter(map(len, words), np.int64, len(words)) + 4


def _two_buckets(hashed: np.ndarray, buckets: int) -> np.ndarray:
    first = (hashed ^ hashed >> np.uint32(13)) * np.uint32(0x85EBCA6B)
    second = (hashed ^ hashed >> np.uint32(17)) * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
    return np.stack([(h ^ h >> np.uint32(16)) % np.uint32(buckets) for h in (first, second)]).astype(np.int64)


def evidence_of(odds: np.ndarray, f: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    """Of every word and of every n-gram, from a table with one row per hash function, words before n-grams."""
    words, grams = np.split(odds, [odds.shape[1] * WORD_BUCKETS // (WORD_BUCKETS + NGRAM_BUCKETS)], axis=1)
    return np.minimum(words[0][f.word[0]], words[1][f.word[1]]), np.minimum(grams[0][f.grams[0]], grams[1][f.grams[1]])


@dataclass
class ToxicityModel:
    odds: np.ndarray
    word_vectors: np.ndarray
    gram_vectors: np.ndarray
    params: gru.Params

    def inputs(self, f: WordFeatures) -> np.ndarray:
        """One input vector per word; every word has n-grams, as its ends count as characters."""
        if not len(f.sizes):
            return np.zeros((0, 3 + 2 * WIDTH), np.float32)
        starts, count = np.cumsum(f.sizes) - f.sizes, f.sizes[:, None].astype(np.float32)
        word_odds, gram_odds = evidence_of(self.odds, f)
        return np.concatenate(
            (
                word_odds[:, None],
                np.maximum.reduceat(gram_odds, starts)[:, None],
                np.add.reduceat(gram_odds, starts)[:, None] / count,
                self.word_vectors[f.word[0] % EMBEDDED],
                np.add.reduceat(self.gram_vectors[f.grams[0] % EMBEDDED], starts, axis=0) / count,
            ),
            axis=1,
            dtype=np.float32,
        )

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """The highest window probability of each text; 0 for a text without a word."""
        words, at, counts = split_words(texts)
        out = np.zeros(len(texts))
        if not len(at):
            return out
        x = np.concatenate([*(self.inputs(f) for _, f in features_in_turn(words)), np.zeros((1, 3 + 2 * WIDTH), np.float32)])
        projected = {d: x @ self.params[f"x{d}"] + self.params[f"c{d}"] for d in "fb"}
        begins, owner = window_starts(counts)
        limit = np.cumsum(counts)
        for k in range(0, len(begins), WINDOWS):
            place = begins[k : k + WINDOWS] + np.arange(STEPS)[:, None]
            mask = place < limit[owner[k : k + WINDOWS]]
            rows = np.where(mask, at[np.minimum(place, len(at) - 1)], len(words))
            logits = gru.score(self.params, projected, rows, mask)
            np.maximum.at(out, owner[k : k + WINDOWS], gru.sigmoid(logits.astype(np.float64)))
        return out


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window starts in the words of all texts, and whose it is. Every word is in a window."""
    n = np.where(counts > 0, 1 + np.ceil(np.maximum(counts - STEPS, 0) / STRIDE).astype(np.int64), 0)
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[owner] + nth * STRIDE, owner


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where a block of text is full; a longer text is a block of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        block = size // BLOCK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
                give_back()


@dataclass
class FeatureCounts:
    """Per label (clean, toxic): documents; per hash function and bucket, documents that have it; contexts.

    ``seen`` is (hash, label, bucket), words before n-grams, a document counting an n-gram once for
    each distinct word that has it; ``contexts`` is (label, bucket) of the first hash.
    """

    rows: np.ndarray
    seen: np.ndarray
    contexts: np.ndarray

    def evidence(self, left_out: int | None = None) -> np.ndarray:
        """Smoothed log-odds by hash function and bucket, drawn to 0 where a feature has few contexts.

        ``left_out`` is the label of a row whose own share is taken away, for what its features
        say without it. Contexts are the distinct words that stood before a feature: words that
        toxic documents share only as copies of each other have no more than one has.
        """
        less = np.array([left_out == 0, left_out == 1], float)[:, None]
        rows, around, out = np.maximum(self.rows[:, None] - less, 0), np.maximum(self.contexts - less, 0), []
        for k in range(2):
            seen = np.maximum(self.seen[k] - less, 0)
            odds = np.log((seen[1] + 0.5) / (rows[1] + 1)) - np.log((seen[0] + 0.5) / (rows[0] + 1))
            support = np.where(odds > 0, around[1], around[0]) if k == 0 else seen.sum(axis=0)
            out.append(odds * support / (support + 4) / 3)
        return np.array(out, np.float32)


def word_uses(words: list[bytes], at: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per label and word: the documents that have it, and the marks (one of 64 bits each) of the words before it."""
    times, around = np.zeros((2, len(words)), np.int32), np.zeros((2, len(words)), np.uint64)
    buckets, owner = word_buckets(words)[1], np.repeat(np.arange(len(toxic)), sizes)
    for label in (0, 1):
        own = np.flatnonzero(toxic[owner] == label)
        if not len(own):
            continue
        once = np.unique(owner[own] * np.int64(len(words)) + at[own]) % len(words)
        times[label] = np.bincount(once, minlength=len(words))
        before = np.where((own > 0) & (owner[own - 1] == owner[own]), buckets[at[own - 1]], 1) % 64
        pairs = np.unique(at[own] * 64 + before)
        first = np.flatnonzero(np.diff(pairs // 64, prepend=-1))
        around[label, pairs[first] // 64] = np.bitwise_or.reduceat(np.uint64(1) << (pairs % 64).astype(np.uint64), first)
    return times, around


def count_features(labelled: DataFrame) -> FeatureCounts:
    """Counted over the whole texts of all labelled rows; the driver gets one row per bucket.

    Distinct contexts are kept as 64 marks per bucket and label, which Spark joins with ``bit_or``
    (linear counting: more than a few hundred can't be told apart, nor need they be).
    """
    width = WORD_BUCKETS + NGRAM_BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        counts, marks, any_rows = np.zeros((2, 2, width + 1), np.int32), np.zeros((2, width + 1), np.uint64), False
        for batch in _pieces(batches):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            words, at, sizes = split_words(utf8(batch.column("text")))
            any_rows = True
            for label in (0, 1):
                counts[0, label, width] += (toxic == label).sum()
            times, around = word_uses(words, at, sizes, toxic)
            for own, f in features_in_turn(words):
                for label in np.flatnonzero(times[:, own].any(axis=1)).tolist():
                    n, mark = times[label, own], around[label, own]
                    of_grams = np.repeat(n, f.sizes)
                    for k in range(2):
                        np.add.at(counts[k, label], f.word[k], n)
                        np.add.at(counts[k, label], WORD_BUCKETS + f.grams[k], of_grams)
                    np.bitwise_or.at(marks[label], f.word[0], mark)
                    np.bitwise_or.at(marks[label], WORD_BUCKETS + f.grams[0], np.repeat(mark, f.sizes))
        if any_rows:
            table = np.concatenate((counts.reshape(4, -1).astype("<i8"), marks.view("<i8")))
            yield _blobs(table, TaskContext.get().partitionId())

    parts = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, BLOB)
    for _ in range(TREE_LEVELS):  # the counts of up to TREE_WIDTH tasks meet in one, and of these again
        parts = parts.withColumn("task", F.expr(f"task div {TREE_WIDTH}")).groupBy("part", "task").applyInArrow(_merge_blobs, BLOB)
    got = parts.mapInArrow(_unfold_blobs, "bucket long, c0 long, t0 long, c1 long, t1 long, cm long, tm long")
    sums = got.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")], *[F.bit_count(F.bit_or(c)).alias(c) for c in ("cm", "tm")])
    found = sums.toArrow()
    table = np.zeros((6, width + 1))
    for k, name in enumerate(("c0", "t0", "c1", "t1", "cm", "tm")):
        table[k, found["bucket"].to_numpy()] = found[name].to_numpy()
    del found
    contexts = -64 * np.log1p(-np.minimum(table[4:], 63.5) / 64)
    return FeatureCounts(table[:2, width], table[:4, :width].reshape(2, 2, width), contexts[:, :width])


#: A task's counts travel as compressed parts of the table, not as a row for each bucket.
BLOB = "part int, task int, n int, packed binary"
PART_BUCKETS, TREE_WIDTH, TREE_LEVELS = 1 << 15, 64, 3


def _blobs(table: np.ndarray, task: int) -> pa.RecordBatch:
    """``table`` has four rows of counts and two of marks, one column for each bucket."""
    rows = []
    for part, low in enumerate(range(0, table.shape[1], PART_BUCKETS)):
        own = table[:, low : low + PART_BUCKETS]
        used = np.flatnonzero(own.any(axis=0))
        if len(used):
            planes = np.ascontiguousarray(np.concatenate((used[None], own[:, used])), "<i8").view(np.uint8).reshape(7, len(used), 8).transpose(0, 2, 1)
            rows.append((part, task, len(used), zstandard.ZstdCompressor(level=3).compress(planes.tobytes())))
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "task", "n", "packed"])


def _unfold(n: int, packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(7, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(7, n)


def _merge_blobs(blobs: pa.Table) -> pa.Table:
    """One blob of all the blobs of a part: counts are added, marks are joined."""
    part, task = blobs["part"][0].as_py(), blobs["task"][0].as_py()
    table = np.zeros((6, PART_BUCKETS), np.int64)
    for n, packed in zip(blobs["n"].to_pylist(), blobs["packed"].to_pylist(), strict=True):
        own = _unfold(n, packed)
        table[:4, own[0]] += own[1:5]
        table[4:, own[0]] |= own[5:]
    merged = pa.Table.from_batches([_blobs(table, task)])
    return merged.set_column(0, "part", pa.array([part] * len(merged), pa.int32()))


def _unfold_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, n, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "packed")), strict=True):
            own = _unfold(n, packed)
            own = np.concatenate((own[:1] + part * PART_BUCKETS, own[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], ["bucket", "c0", "t0", "c1", "t1", "cm", "tm"])


def choose_windows(sample: DataFrame, others: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, list[bytes]]]:
    """``(label, words)`` of the windows of most evidence and, of clean rows, some more of the text.

    A toxic row's label says nothing of which window is toxic: windows with no more evidence than
    most of the chosen clean windows have are left out. ``others`` is the evidence without a row's own share,
    by the row's label.
    """
    odds = shared(sample.sparkSession, others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        odds_of = odds()
        for batch in _pieces(batches):
            labels, texts = batch.column("toxic").to_pylist(), utf8(batch.column("text"))
            words, at, sizes = split_words(texts)
            if not len(at):
                continue
            strengths = np.zeros((2, len(words)), np.float32)
            for own, f in features_in_turn(words):
                starts = np.cumsum(f.sizes) - f.sizes
                strengths[:, own] = [w + np.maximum.reduceat(g, starts) for w, g in (evidence_of(o, f) for o in odds_of)]
            out_labels, out_words, out_strength = [], [], []
            for label, own in zip(labels, np.split(at, np.cumsum(sizes)[:-1]), strict=True):
                begins, _ = window_starts(np.array([len(own)]))
                evidence = strengths[label]
                strength = [evidence[own[b : b + STEPS]].max() for b in begins.tolist()]
                ranked = np.argsort(strength, kind="stable")[::-1]
                if label:
                    chosen = [k for k in ranked[:2].tolist() if strength[k] >= 0.7 * strength[ranked[0]]]
                else:
                    chosen = dict.fromkeys([*ranked[:3].tolist(), *ranked[len(ranked) // 2 :: max(1, len(ranked) // 4)].tolist()])
                for k in chosen:
                    out_labels.append(label), out_strength.append(strength[k])
                    out_words.append(b" ".join(words[w] for w in own[begins[k] : begins[k] + STEPS].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(out_labels, pa.int32()), pa.array(out_words, pa.binary()), pa.array(out_strength, pa.float64())], ["toxic", "words", "strength"])

    got = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, words binary, strength double").collect()
    usual = np.quantile([r["strength"] for r in got if not r["toxic"]] or [0], 0.95)
    return sorted((r["toxic"], bytes(r["words"]).split(b" ")) for r in got if not r["toxic"] or r["strength"] > usual)


def fit(
    model: ToxicityModel, windows: list[tuple[int, list[bytes]]], others: tuple[np.ndarray, np.ndarray], steps: int = 400, batch: int = 256, rate: float = 0.01
) -> None:
    """Adam over shuffled batches of windows; both labels weigh the same.

    A window's words are looked up in the evidence that leaves its own row out (``others`` by label):
    the two tables lie behind each other, and the label chooses the half.
    """
    rng = np.random.default_rng(5)
    halves = [o[:, part] for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, None)) for o in others]
    trainee = ToxicityModel(np.concatenate(halves, axis=1), model.word_vectors, model.gram_vectors, model.params)
    words = sorted({(v, w) for v, ws in windows for w in ws})
    number = {w: k for k, w in enumerate(words)}
    f = word_features([w for _, w in words])
    half = np.array([v for v, _ in words], np.int64)
    f = f.of(np.arange(len(words)), half)
    at = np.full((STEPS, len(windows)), len(words))
    for k, (v, ws) in enumerate(windows):
        at[: len(ws), k] = [number[v, w] for w in ws]
    label = np.array([v for v, _ in windows], np.float32)
    share = np.where(label > 0, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())).astype(np.float32) * len(label)
    learned = {**model.params, "word_vectors": model.word_vectors, "gram_vectors": model.gram_vectors}
    first, second, step = {k: np.zeros_like(v) for k, v in learned.items()}, {k: np.zeros_like(v) for k, v in learned.items()}, 0
    while step < steps and windows:
        order = rng.permutation(len(windows))
        for k in range(0, len(order), batch):
            rows, step = order[k : k + batch], step + 1
            used, inverse = np.unique(at[:, rows], return_inverse=True)
            own = used[used < len(words)]
            part = f.of(own)
            table_x = np.concatenate((trainee.inputs(part), np.zeros((1, 3 + 2 * WIDTH), np.float32)))
            at_x = inverse.reshape(STEPS, len(rows))
            mask = at[:, rows] < len(words)
            at_x = np.where(mask, at_x, len(own))
            logit, kept = gru.forward(model.params, table_x[at_x], mask)
            grad, to_x = gru.backward(model.params, kept, (gru.sigmoid(logit) - label[rows]) * share[rows] / len(rows))
            flat = np.zeros((len(own) + 1, to_x.shape[2]), np.float32)
            np.add.at(flat, at_x.ravel(), to_x.reshape(-1, to_x.shape[2]))
            grad["word_vectors"], grad["gram_vectors"] = np.zeros_like(model.word_vectors), np.zeros_like(model.gram_vectors)
            np.add.at(grad["word_vectors"], part.word[0] % EMBEDDED, flat[:-1, 3 : 3 + WIDTH])
            np.add.at(grad["gram_vectors"], part.grams[0] % EMBEDDED, np.repeat(flat[:-1, 3 + WIDTH :] / part.sizes[:, None], part.sizes, axis=0))
            for name, value in learned.items():
                first[name] = 0.9 * first[name] + 0.1 * grad[name]
                second[name] = 0.99 * second[name] + 0.01 * grad[name] ** 2
                value -= (rate / 50 if name.endswith("vectors") else rate) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ToxicityModel:
    """The model learned from ``docs`` (``doc_id, text``) by ``labels`` (``doc_id, toxic``).

    Rows with a null in any of these, and labels other than 0 and 1, teach nothing.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = count_features(texts.join(known.hint("merge"), "doc_id"))  # the same join at every size
    clean, toxic = counts.rows
    odds, others = counts.evidence(), (counts.evidence(left_out=0), counts.evidence(left_out=1))
    rng = np.random.default_rng(3)
    model = ToxicityModel(
        odds,
        (0.05 * rng.standard_normal((EMBEDDED, WIDTH))).astype(np.float32),
        (0.05 * rng.standard_normal((EMBEDDED, WIDTH))).astype(np.float32),
        gru.init(3 + 2 * WIDTH, HIDDEN, ATTENTION, rng),
    )
    if not toxic:
        model.params["bo"][:] = -20  # nothing toxic was seen: every text scores low
        model.params["wo"][:] = 0
        return model
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, bound / toxic))).otherwise(F.lit(min(1.0, bound / max(1, clean))))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    fit(model, choose_windows(texts.join(F.broadcast(chosen), "doc_id"), others), others)  # about 2 x bound ids
    return model


def predict(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` per row of ``docs``.

    Every overlapping window of the whole text is scored; the highest counts. A null, empty or
    wordless text scores 0. Repeated rows and null ids stay. Columns other than ``doc_id`` and
    ``text`` are not read. An empty table gives an empty result.
    """
    fitted = shared(docs.sparkSession, model)  # as large as its hash buckets, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        model = fitted()
        for batch in _pieces(batches):
            score = model.score(utf8(batch.column("text")))
            columns = [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; the texts are not shuffled."""
    fitted = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        model = fitted()
        for batch in _pieces(batches):
            yield batch.filter(pa.array(model.score(utf8(batch.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def learning(rows: DataFrame) -> DataFrame:
    """The rows one may learn from: ``crc32(doc_id) mod 3`` is not 1."""
    return rows.where(remainder("doc_id", 3) != 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(learning(docs), learning(table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
