"""Line dedup against a plain count, its state against one made anew, and the filter against a multiset."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from subsight.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def plain(texts, of, min_docs):
    """``texts`` deduplicated by the counts of ``of``."""
    counts = Counter(k for t in of for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        own = (t or "").split("\n")
        kept = [x for x in own if counts[key(x)] < min_docs]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def random_texts(seed, n, words=12):
    rng = random.Random(seed)
    ends = ["", " ", "\t", "\r", "\x0b ", " \x0c"]
    vocabulary = [f"Line {k} ÀÉ" for k in range(words)] + ["", " ", "\xa0", "İ", "x" * 3000]
    return ["\n".join(rng.choice(ends) + rng.choice([str.upper, str.lower, str])(rng.choice(vocabulary)) + rng.choice(ends) for _ in range(rng.randrange(1, 9))) for _ in range(n)] + [None, "", "\n", "\n\n"]


def frame(spark, texts):
    return spark.createDataFrame([(k if k % 5 else None, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, key int, row string").repartition(3)


def got(df):
    return Counter(tuple(r)[1:] for r in df.collect())


def test_against_a_plain_count(spark):
    texts = random_texts(1, 60) + ["hot line\nown"] * 40 + ["a\n" * 4000 + "hot line"]
    df = frame(spark, texts)
    assert got(lines.dedup(df)) == Counter(plain(texts, texts, 10))
    assert got(lines.dedup(df, min_docs=1)) == Counter(plain(texts, texts, 1))
    ids = Counter(r["doc_id"] for r in lines.dedup(df).collect())
    assert ids == Counter(k if k % 5 else None for k in range(len(texts)))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup(empty).collect() == []
    state = lines.insert(lines.build(empty, 2), frame(spark, ["a", "a", "b"]), 2)
    assert got(lines.dedup(frame(spark, ["a\nb"]), state, 2)) == Counter([(2, 1, "b")])


def exact(state):
    return {bytes(r["key"]): r["n"] for r in state.counts.collect()}


def filters(state):
    return {r["shard"]: lines.Cuckoo(r["buckets"], r["slots"]) for r in state.filters.collect()}


def test_insertions_and_deletions_lead_back(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    a, b = random_texts(2, 30, words=20), random_texts(3, 40, words=60)
    first, more = frame(spark, a), frame(spark, b)
    start = lines.build(first, 3)
    both = lines.insert(start, more, 3)
    assert start.shards > 1
    assert exact(both) == exact(lines.build(first.unionByName(more), 3))
    assert got(lines.dedup(first, both, 3)) == Counter(plain(a, a + b, 3))
    back = lines.delete(both, more, 3)
    assert exact(back) == exact(start)
    assert got(lines.dedup(more, back, 3)) == Counter(plain(b, a, 3))
    held = lambda s: {k: int((f.slots > 0).sum()) for k, f in filters(s).items() if (f.slots > 0).any()}
    assert held(back) == held(start)
    nothing = lines.delete(back, first, 3)
    assert exact(nothing) == {} and held(nothing) == {}


def test_what_was_never_inserted_cannot_be_deleted(spark):
    state = lines.build(frame(spark, ["a", "b"]), 2)
    with pytest.raises(Exception, match="never inserted"):
        lines.delete(state, frame(spark, ["c"]), 2)


def some_keys(n, seed=0):
    return np.frombuffer(b"".join(hashlib.md5(f"{seed}:{k}".encode()).digest() for k in range(n)), np.uint8).reshape(-1, 16)


def test_filter_forgets_no_key_and_passes_few_others():
    keys, others = some_keys(5000), some_keys(20000, 1)
    made = lines.filter_of(keys)
    assert made.holds(keys).all()
    assert made.holds(others).mean() < 0.001
    made.delete(keys[:2500])
    assert made.holds(keys[2500:]).all() and made.holds(keys[:2500]).mean() < 0.01
    assert made.insert(keys[:2500]) and made.holds(keys).all()


def test_a_full_filter_says_so_and_an_unknown_key_cannot_go():
    small = lines.Cuckoo(2)
    assert not small.insert(some_keys(9))
    with pytest.raises(RuntimeError):
        lines.Cuckoo(4).delete(some_keys(1))


def test_query_against_a_plain_count_and_sql(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] for r in docs]
    want = sorted((d["doc_id"], n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in zip(docs, plain(texts, texts, 10)))
    found = sorted(tuple(r) for r in lines.op13_lines(spark, path).collect())
    assert found == want and any(r[2] for r in found)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    assert sorted(con.sql(lines.OP13_SQL).fetchall()) == found
