"""Language identification by error-correcting output codes.

Every language has a codeword of +1 / -1 bits. One logistic classifier per bit, on hashed byte
n-grams of the whole text, says which side of that bit the text is on; the margins are decoded to
the language whose codeword has the least total loss (Allwein, Schapire and Singer, 2000). The gap
to the runner-up flags ambiguous texts.

The classifiers are fitted with numpy on a bounded sample of labelled rows; the rows, their
features and all predictions are computed on the executors from whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm.common import shared, table, utf8

#: Hash buckets of byte n-grams; n-gram sizes.
BUCKETS = 4096
SIZES = (2, 3, 4)
#: Labelled texts the classifiers are fitted on, over all languages (a bound on the fit alone).
SAMPLE = 3000
#: Bytes hashed at a time; bounds the memory a very long text takes.
PIECE = 1 << 20
#: A text whose two best languages are closer than this (in probability) is ambiguous.
AMBIGUOUS = 0.2
UNDETERMINED = "und"

#: ASCII letters in lower case, other ASCII as a space, bytes of other characters as they are.
FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text, a space standing before and after it."""
    out, tail = np.zeros(BUCKETS, np.int64), b" "
    for k in range(0, max(1, len(text)), PIECE):
        piece = tail + text[k : k + PIECE].translate(FOLD) + (b" " if k + PIECE >= len(text) else b"")
        codes = np.frombuffer(piece, np.uint8).astype(np.uint32)
        carried = len(tail) if k else 0
        for size in SIZES:
            if len(codes) < size:
                continue
            rolled = np.full(len(codes) - size + 1, size, np.uint32)
            for i in range(size):
                rolled = rolled * np.uint32(0x01000193) ^ codes[i : i + len(rolled)]
            rolled = (rolled ^ rolled >> np.uint32(15)) * np.uint32(0x85EBCA6B)
            skip = max(0, carried - size + 1)  # n-grams that lie whole in what was carried over were counted
            out += np.bincount((rolled[skip:] >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
        tail = piece[-(max(SIZES) - 1) :]
    return out


def features(text: bytes) -> np.ndarray:
    counts = ngram_counts(text)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of +1 / -1. Up to six languages: every split in two; more: the random code of the widest distance."""
    if n <= 6:
        splits = range(1, 1 << (n - 1)) if n > 1 else ()
        return np.array([[1 if s >> row & 1 else -1 for s in splits] for row in range(n)], float).reshape(n, max(0, (1 << n >> 1) - 1))
    rng, best, width = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if apart > width and (abs(code.sum(axis=0)) < n).all():
            best, width = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row of features: the probabilities of the languages, from the total loss of their codewords."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p


def fit(x: np.ndarray, labels: list[str], steps: int = 120, rate: float = 0.5, decay: float = 1e-5) -> LanguageModel:
    """One logistic classifier per bit, all at once, by full-batch Adam with equal weight for each language."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    at = np.array([languages.index(v) for v in labels], int)
    goal = code[at].astype(np.float32) if len(at) else np.zeros((0, code.shape[1]), np.float32)
    weights, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if not goal.size:
        return LanguageModel(languages, code, weights, bias)
    share = (1 / np.bincount(at, minlength=len(languages)))[at][:, None].astype(np.float32) / len(languages)
    moments = [np.zeros_like(p) for p in (weights, weights, bias, bias)]
    for step in range(1, steps + 1):
        pull = -goal * share / (1 + np.exp(np.clip(goal * (x @ weights + bias), -30, 30)))
        for p, grad, k in ((weights, x.T @ pull + decay * weights, 0), (bias, pull.sum(axis=0), 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * grad**2
            p -= rate * moments[k] / (1 - 0.9**step) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-9)
    return LanguageModel(languages, code, weights, bias)


def _sampled(rows: DataFrame, label: str, bound: int) -> DataFrame:
    """About ``bound`` rows, as many of each label as there are, chosen by a hash of the id."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.coalesce(
        *[F.when(F.col(label) == F.lit(k), F.lit(min(1.0, bound / len(counts) / n))) for k, n in counts.items()], F.lit(0.0)
    )
    return rows.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))


def train(labelled: DataFrame, bound: int = SAMPLE) -> LanguageModel:
    """The model of ``labelled`` (``doc_id, text, lang``): whole texts and one short passage of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                at = len(text) // 3
                langs += [lang, lang]
                rows += [features(text).astype("<f2").tobytes(), features(text[at : at + 60]).astype("<f2").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "x"])

    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    got = _sampled(usable, "lang", bound).mapInArrow(run, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], "<f2") for r in got], np.float32).reshape(-1, BUCKETS)
    return fit(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` per row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text where no
    language was learned. Texts of any length are scored whole; repeated rows and null ids stay.
    Columns other than ``doc_id`` and ``text`` are not read. An empty table gives an empty result.
    """
    fitted = shared(docs.sparkSession, model)  # BUCKETS x bits numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted()
        for batch in batches:
            langs, scores, unsure = [], [], []
            for text in utf8(batch.column("text")):
                if not text or not model.languages or not has_letter(text):
                    langs.append(UNDETERMINED), scores.append(0.0), unsure.append(True)
                    continue
                best, p = model.decode(features(text)[None])
                top = np.sort(p[0])
                langs.append(model.languages[best[0]]), scores.append(float(top[-1]))
                unsure.append(bool(len(top) > 1 and top[-1] - top[-2] < AMBIGUOUS))
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def remainder(column: str, by: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(remainder("doc_id", 5) != 0))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
