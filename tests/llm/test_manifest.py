"""The manifest against trees built whole in Python, level by level, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest

from subsight.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, proof int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def shown(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(level, k):
    """Root and siblings of node ``k``, by hashing all levels."""
    proof = []
    while len(level) > 1:
        if (k ^ 1) < len(level):
            proof.append((k & 1, level[k ^ 1]))
        else:
            proof.append(None)
        level, k = [h("".join(level[j : j + 2])) for j in range(0, len(level), 2)], k >> 1
    return level[0], proof


def plain(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = [(r, h(shown(r))) for r in rows if r[2] == lang]
        trees[lang] = sorted(own, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    subroots = [climb([d for _, d in trees[lang]], 0)[0] for lang in langs]
    out = []
    for j, lang in enumerate(langs):
        root, top = climb(subroots, j)
        for k, (r, d) in enumerate(trees[lang]):
            proof = climb([x for _, x in trees[lang]], k)[1] + top
            folded = d
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                folded = h(shown((*r[:3], r[3] + 1, r[4])))
            for p in proof:
                folded = h(folded) if p is None else h(p[1] + folded) if p[0] else h(folded + p[1])
            out.append((r[0], d, subroots[j], root, h("".join(p[1] for p in proof if p)), folded, folded == root))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in manifest.audit(df, manifest.tampered()).collect()), key=str)


@pytest.mark.parametrize(("band", "n"), [(1, 5), (1, 9), (2, 1), (2, 8), (2, 17), (8, 2), (8, 3), (8, 17)])
def test_sizes_against_whole_trees(spark, monkeypatch, band, n):
    monkeypatch.setattr(manifest, "BAND", band)
    rows = [(k, "s", "en", k, "t" * k) for k in range(n)]
    assert run(spark, rows) == plain(rows)


def test_odd_rows_against_whole_trees(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BAND", 2)
    rows = [(k, "web", "en", 5, f"text {k}") for k in range(70)]
    rows += [(k, None, None, None, None) for k in range(100, 109)] + [(k, "", "", 0, "") for k in range(200, 203)]
    rows += [(7, "web", "en", 5, "text 7")] * 20 + [(7, "web", "en", 6, "other")] * 3  # repeated rows, equal ids
    rows += [(None, "a", "de", 1, "z"), (None, "a", "de", 1, "z"), (-5, "a", "de", 1, "é" * 1000), (2, "a", "ü", 1, "x"), (3, "a", "EN", 1, "x" * 50000)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_an_untouched_copy_verifies(spark):
    df = spark.createDataFrame([(k, "s", "en" if k % 3 else None, k, "t") for k in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest.audit(df).collect()
    assert len(found) == 300 and all(r["verified"] for r in found)


def test_query_against_whole_trees_and_sql(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = sorted((tuple(r) for r in manifest.op12_manifest(spark, path).collect()), key=str)
    assert got == plain([tuple(r) for r in docs])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    assert sorted(con.sql(manifest.OP12_SQL).fetchall(), key=str) == got
