"""URL rules against a plain parser, mined rules against counts of all combinations and the SQL."""

import math
import re
from collections import Counter
from itertools import combinations

import duckdb

from subsight.llm import urls

SMALL = "/root/testdata/sf0.01"


def plain_parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_tokens(url):
    host, path = plain_parse(url)
    if not url or "://" not in url:
        return set()
    query = url.split("://", 1)[1].split("#")[0].partition("?")[2]
    out = {"h:" + x for x in host.split(".") if x} | {"p:" + re.sub("[0-9]+", "0", x) for x in path.split("/") if x}
    return out | {"q:" + x.split("=")[0] for x in query.split("&") if x.split("=")[0]}


def plain_mine(rows):
    rows = [(plain_tokens(u), b) for u, b in rows if b is not None and plain_tokens(u)]
    least = math.ceil(urls.MIN_SUPPORT * len(rows))
    both, bad = Counter(), Counter()
    for tokens, b in rows:
        for n in (1, 2):
            for c in combinations(sorted(tokens), n):
                both[c] += 1
                bad[c] += b
    return {c for c, n in bad.items() if n >= max(1, least) and n >= urls.MIN_CONFIDENCE * both[c]}


ODD = [
    None,
    "",
    "no scheme.net/x",
    "http://",
    "http://net/",
    "http://NET/a",
    "http://a.b.net",
    "http://a.net?x",
    "HTTPS://A.Example.NET/en/1",
    "http://example.net/en",
    "http://badexample.net/en/1",
    "http://x.example.com/de/?a=1&b",
    "http://example.com/DE/",
    "http://a.org/fr/#/x?y",
    "x://y://z/net/",
    "http://h/a?b://c#d",
    "http://h#f?g=1",
    "http://é.ORG/fr/é",
    "http://h/" + "a/" * 3000,
    "http://h\n.net/a\nb",
]


def test_parsing_rules_and_tokens(spark):
    df = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(ODD)] * 2, "page_id long, url string, host string, mined int")
    tokens = {r["page_id"]: r["t"] for r in df.select("page_id", urls.tokens_of(df["url"]).alias("t")).collect()}
    assert {k: set(t) for k, t in tokens.items()} == {k: plain_tokens(u) for k, u in enumerate(ODD)}
    none = urls.mine_rules(spark.createDataFrame([], "url string, bad boolean"))
    got = urls.judge(df, none).collect()
    assert len(got) == 2 * len(ODD)
    for r in got:
        host, path = plain_parse(ODD[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["mined"]) == (host, path, rule, verdict or "allow", False)


def test_mined_rules_against_all_combinations(spark):
    rows = [(f"http://{'spam' if k % 7 == 0 else 'ok'}{k % 3}.com/{'win' if k % 5 == 0 else 'a'}/{k}", k % 7 == 0 or k % 15 == 0) for k in range(200)]
    rows += [(None, True), ("http://x.com/", None), ("nothing", True)]
    rules = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    want = plain_mine(rows)
    assert {tuple(r["tokens"]) for r in rules.collect()} == want and want
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r["mined"] for r in urls.judge(pages, rules).collect()}
    assert got == {k: any(plain_tokens(u) >= set(c) for c in want) for k, (u, _) in enumerate(rows)}


def mine_all(rows):
    """Like plain_mine, with combinations of every size."""
    rows = [(plain_tokens(u), b) for u, b in rows if b is not None and plain_tokens(u)]
    both, bad = Counter(), Counter()
    for tokens, b in rows:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                both[c] += 1
                bad[c] += b
    return {c for c, n in bad.items() if n >= max(1, math.ceil(urls.MIN_SUPPORT * len(rows))) and n >= urls.MIN_CONFIDENCE * both[c]}


def test_combinations_that_are_bad_only_together(spark):
    # spam, win and q are each, and in pairs, more common on good pages; with three (or four) of them a page is bad
    shapes = [("http://spam.com/win/?q=1", True, 10), ("http://spam.com/win/", False, 30), ("http://spam.com/?q=1", False, 30), ("http://x.com/win/?q=1", False, 30)]
    parts = ["a.com/b/c/?d", "z.com/b/c/?d", "a.com/z/c/?d", "a.com/b/z/?d", "a.com/b/c/?z"]
    shapes += [(f"http://{p}=1", k == 0, 10 if k == 0 else 40) for k, p in enumerate(parts)]
    shapes += [("http://alone.com/win/", True, 9)]
    rows = [(u, b) for u, b, n in shapes for _ in range(n)]
    rules = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    every = mine_all(rows)
    short = [set(c) for c in every if len(c) <= 2]
    assert {tuple(r["tokens"]) for r in rules.collect()} == {c for c in every if len(c) <= 2 or not any(s <= set(c) for s in short)}
    pages = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(shapes)], "page_id long, url string")
    got = {r["page_id"]: (r["mined"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    want = {k: any(plain_tokens(u) >= set(c) for c in every) for k, (u, _, _) in enumerate(shapes)}
    assert got == {k: (hit, "block" if hit else "allow") for k, hit in want.items()}
    assert [k for k, hit in want.items() if hit] == [k for k, (_, b, _) in enumerate(shapes) if b]
    assert not any(len(c) <= 2 and set(c) <= plain_tokens(shapes[0][0]) for c in every)


def test_query_against_brute_force_and_sql(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()
    labels = {r["doc_id"]: r["quality"] == 0 for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    mined = mine_all([(u, labels[k]) for k, u in pages if k in labels])
    want = set()
    for k, u in pages:
        host, path = plain_parse(u)
        rule, verdict = plain_rule(host, path)
        hit = any(plain_tokens(u) >= set(c) for c in mined)
        want.add((k, host, path, rule, verdict or ("block" if hit else "allow"), hit))
    assert {tuple(r) for r in urls.op4_urls(spark, SMALL).collect()} == want
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert set(con.execute(urls.OP4_SQL).fetchall()) == want
    assert any(w[-1] for w in want)


def test_query_against_combinations_of_every_size(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()
    labels = {r["doc_id"]: r["quality"] == 0 for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    mined = [set(c) for c in mine_all([(u, labels[k]) for k, u in pages if k in labels])]
    want = {k: any(plain_tokens(u) >= c for c in mined) for k, u in pages}
    got = urls.op4_urls(spark, SMALL).select("page_id", "mined").collect()
    assert len(got) == len(pages) and {tuple(r) for r in got} == set(want.items())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, urls.mine_rules(spark.createDataFrame([("http://a.b/", True)], "url string, bad boolean"))).collect() == []
