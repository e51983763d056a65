"""Pigeonhole edit matching against the plain edit-distance table over whole texts."""

import random

from subsight.llm import decontamination as d


def plain_search(item, text):
    """Fewest edits of the item against any passage, by dynamic programming."""
    column = list(range(len(item) + 1))
    best, end = column[-1], 0
    for j, c in enumerate(text, 1):
        diagonal, column[0] = column[0], 0
        for i, x in enumerate(item, 1):
            diagonal, column[i] = column[i], min(diagonal + (x != c), column[i] + 1, column[i - 1] + 1)
        if column[-1] < best:
            best, end = column[-1], j
    return best, end


def plain(docs, items):
    out = []
    for doc, text in docs:
        for item, wanted in items:
            wanted, whole = d.normalised(wanted), d.normalised(text)
            if wanted and whole:
                edits, end = plain_search(wanted, whole)
                if edits <= d.budget(wanted) and end:
                    out.append((doc, item, edits, d.budget(wanted), end))
    return sorted(out, key=str)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([[], [rng.choice("abcde ")], [chars[k], "x"]])
    return "".join(chars)


def test_planted_edits_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(4, 16)))) for k in range(12)]
    docs = []
    for k in range(60):
        item = rng.choice(items)[1]
        filler = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(2)]
        docs.append((k, f"{filler[0]}\n {edited(rng, item.upper() if k % 3 else item, k % 9)}  {filler[1]}"))
    docs += [(100, items[0][1] + " zz " + items[1][1] + " " + edited(rng, items[0][1], 2)), (101, items[2][1][5:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert sorted(map(tuple, d.benchmark_matches(df, bench).collect()), key=str) == want and len(want) > 20
    assert sorted(map(tuple, d.benchmark_matches(df, bench, block_chars=150).collect()), key=str) == want
    left = {r["doc_id"] for r in d.without_benchmark(df, bench, block_chars=150).collect()}
    assert left == {k for k, _ in docs} - {w[0] for w in want} and left


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "ab"), (None, "the quick brown fox"), (6, "x " * 50000 + "The  quick\nbrown FOX"), (6, "the quick brown fox")]
    items = [(7, "the quick brown fox"), (7, "the quick brown fox"), (8, None), (9, ""), (None, "ab"), (11, "  ")]
    df = spark.createDataFrame([(k, t, 5, "s") for k, t in docs], "doc_id long, text string, item_id int, edits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, d.benchmark_matches(df, bench).collect()), key=str)
    assert got == sorted([(4, None, 0, 0, 2)] + [(None, 7, 0, 0, 19), (6, 7, 0, 0, 19), (6, 7, 0, 0, 100019)] * 2, key=str)
    kept = d.without_benchmark(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert d.benchmark_matches(docs, none).collect() == []
    assert d.without_benchmark(docs, none).count() == 1
    assert d.benchmark_matches(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_whole_table_against_plain_containment(spark):
    """Every exact passage of the small tables is found, and whatever else is found is within its budget."""
    base = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], d.normalised(r["text"])) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    items = {r["item_id"]: d.normalised(r["text"]) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in d.op5_decontamination(spark, base).collect()}
    exact = {(k, i) for k, t in docs for i, x in items.items() if x in t}
    assert exact == {p for p, e in got.items() if e == 0}
    assert all(e <= d.budget(items[i]) for (_, i), e in got.items())
