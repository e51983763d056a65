"""Each stage of the pipeline on what the one before it kept, against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from subsight.llm import bpe, decontamination, toxicity
from subsight.llm.common import landed
from tests.llm.test_simhash import plain_groups
from tests.llm.test_suffix_dedup import plain

BASE = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    outs, now = [rows_of(docs)], docs
    for name, stage in corpus_pipeline.STAGES:
        now = landed(stage(spark, now, BASE), f"test-{name}")
        outs.append(rows_of(now))
        if name != "bpe":
            assert now.dtypes == docs.dtypes
    whole, clean, one, cut, fair, ids = outs
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    scores = rows_of(toxicity.predict(docs, toxicity.train(toxicity.learning(docs), toxicity.learning(labels))))
    assert set(clean) == {k for k in whole if scores[k]["score"] < toxicity.THRESHOLD} and len(clean) < len(whole)
    _, component = plain_groups({k: r["text"] for k, r in clean.items()})
    assert set(one) == set(component.values()) and len(one) < len(clean)
    for k, _, removed, _, kept in plain([(k, r["text"]) for k, r in one.items()]):
        assert cut[k]["text"] == kept.decode("utf-8", "ignore")
        assert cut[k]["n_chars"] == (len(cut[k]["text"]) if removed else whole[k]["n_chars"])
    items = [decontamination.normalised(r["text"]) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    exact = {k for k, r in cut.items() if any(x in decontamination.normalised(r["text"]) for x in items)}
    assert exact and not exact & set(fair) and len(cut) - len(fair) <= len(exact) + 3
    path = public_tokenizers.path(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert set(ids) == set(fair)
    for k, r in ids.items():
        own = library.encode_ordinary(fair[k]["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(fair[k]["text"].encode()).hexdigest()
    assert rows_of(corpus_pipeline.run(spark, BASE)) == ids


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, an empty text, repeated rows, extra columns; then an empty table."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (None, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "one two three", "en", None, 13, 1.5), (2, None, None, "s", None, None), (3, "", "en", "s", 0, 2.0), (None, "x y z " * 40, None, None, None, None)]
    rows += [(7, "p q r " * 30 + "One two three four five six  seven eight", "en", "s", 9, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id double")
    for docs in (df, df.limit(0)):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = landed(stage(spark, now, str(tmp_path)), f"test-{name}")
            if name != "bpe":
                assert now.columns == df.columns
        got = [r["doc_id"] for r in now.collect()]
        assert got == [] if docs is not df else None in got and 7 not in got


def test_crc_split_is_that_of_the_contract(spark):
    ids = [0, 1, 2, 17, 123456789, -5]
    df = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    assert {r["doc_id"] for r in toxicity.learning(df).collect()} == {k for k in ids if zlib.crc32(str(k).encode()) % 3 != 1}
