"""SimHash against brute force: fingerprints bit by bit, links over all pairs."""

import random
import re
from itertools import combinations

import pytest
import xxhash

from subsight.llm import simhash
from subsight.llm.components import connected_components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_groups(rows):
    fps = {k: plain_fingerprint(t) for k, t in rows.items()}
    links = [(a, b) for a, b in combinations(rows, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    return fps, plain_components(list(rows), links)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps, component = plain_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: (f"{fps[k]:016x}", component[k]) for k in fps}
    assert len(set(component.values())) < len(component)


def test_odd_texts(spark):
    texts = [None, "", " \n", "One", "one", "one two", "ONE TWO", "A b C", "a b c d", "é É", "x " * 70000, "a b c\x1cd e"]
    rows = dict(enumerate(texts))
    df = spark.createDataFrame([(k, t, 7) for k, t in rows.items()] * 2, "doc_id long, text string, fp int")
    fps, component = plain_groups(rows)
    got = simhash.simhash_groups(df).collect()
    assert len(got) == 2 * len(texts)
    assert all((r["fp"] % (1 << 64), r["component_id"]) == (fps[r["doc_id"]], component[r["doc_id"]]) for r in got)
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(component.values())


def test_empty_table_and_null_id(spark):
    schema = "doc_id long, text string"
    assert simhash.simhash_groups(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "q r s t")], schema)
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    assert simhash.keep_representatives(df).count() == 3


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 5, 7])
def test_every_link_is_found(spark, distance):
    rng = random.Random(distance)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(4):
            flipped = base
            for b in rng.sample(range(64), rng.randint(0, 9)):
                flipped ^= 1 << b
            values.add(flipped)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = sorted((r["a"], r["b"]) for r in simhash.fingerprint_links(nodes, distance).collect())
    assert got == sorted((a, b) for a, b in combinations(sorted(signed), 2) if ((a ^ b) % (1 << 64)).bit_count() <= distance)


def test_components_of_chains_hubs_and_nothing(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    links += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    rng.shuffle(links)
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "x long, y long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == plain_components({n for e in real for n in e}, real)
    assert connected_components(spark.createDataFrame([], "x long, y long")).collect() == []
