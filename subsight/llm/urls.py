"""URL filters: given host / path rules, then association rules mined from labels.

Spark's FP-growth mines the combinations of URL tokens, of any size, that go with bad pages. Rules
below the minimum support or confidence are pruned, and so are longer ones that a rule of one or two
of their tokens implies: they fit no further URL. The rest are matched by an inverted index: each rule is
posted under its rarest token only, a URL looks its tokens up there, and the rule fits if the URL
has its other tokens too. Everything is DataFrame and Spark ML code; nothing runs in Python tasks.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm.common import landed, table

#: Fixed rules: (verdict, host, path). A rule fits its host and all subdomains.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Share of the labelled pages that have the combination and are bad; share of bad among those that have it.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.5
BAD = "label=bad"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Host labels, path segments (runs of digits as 0) and names of query fields, each once; none without ``://``."""
    query = F.regexp_extract(F.regexp_extract(_rest(url), r"^[^#]*", 0), r"(?s)\?(.*)$", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    parts = [
        ("h:", F.split(host_of(url), r"\.")),
        ("p:", F.transform(F.split(path_of(url), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))),
        ("q:", names),
    ]

    def marked(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(*[marked(*p) for p in parts]))).otherwise(F.array().cast("array<string>"))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, null where none does."""

    def fits(rule_host: str, rule_path: str) -> Column:
        return ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))

    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    names = [F.when(fits(h, p), F.lit(h + p)) for _, h, p in ranked]
    verdicts = [F.when(fits(h, p), F.lit(v)) for v, h, p in ranked]
    return F.coalesce(*names, F.lit(None).cast("string")), F.coalesce(*verdicts, F.lit(None).cast("string"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(tokens, confidence, support)``: the combinations of URL tokens that go with bad pages.

    All of one and two tokens, and the larger ones that contain none of these. ``labelled`` has ``url`` and ``bad`` (boolean); rows with a null ``bad`` or a URL without tokens teach nothing.
    """
    tokens = tokens_of(F.col("url"))
    baskets = labelled.where(F.col("bad").isNotNull() & (F.size(tokens) > 0)).select(
        F.concat(tokens, F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    baskets = landed(baskets, "baskets")
    if baskets.isEmpty():
        return baskets.select(F.col("items").alias("tokens"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    return landed(unimplied(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")), "url-rules")


def unimplied(rules: DataFrame) -> DataFrame:
    """``rules`` without those of three or more tokens that have all tokens of a rule of one or two."""
    rules = landed(rules, "mined")
    short, long = rules.where(F.size("tokens") <= 2), rules.where(F.size("tokens") > 2)
    parts = long.select("tokens", F.explode("tokens").alias("a")).select("tokens", "a", F.explode("tokens").alias("b")).where("a <= b")
    part = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    implied = parts.select("tokens", part.alias("part")).join(short.select(F.col("tokens").alias("part")), "part", "left_semi").select("tokens").distinct()
    return short.unionByName(long.join(implied, "tokens", "left_anti"))


def matching_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` values that some rule's tokens are all in."""
    own = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("own", tokens_of(F.col("url")))
    numbered = rules.select("tokens")
    wanted = numbered.select(F.explode("tokens").alias("token")).distinct()
    posted = own.select("url", "own", F.explode("own").alias("token"))
    frequency = posted.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = numbered.select("tokens", F.explode("tokens").alias("token")).join(frequency, "token")
    index = ranked.groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return posted.join(index, "token").where(F.size(F.array_except("tokens", "own")) == 0).select("url").distinct()


def judge(pages: DataFrame, rules: DataFrame, fixed: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined)`` per row of ``pages``.

    ``mined`` says whether an association rule fits the URL; the verdict is the fixed rule's where
    one fits, else ``block`` where ``mined``, else ``allow``. A null URL or one without ``://`` has an
    empty host and path and no tokens, and is allowed. Repeated rows stay; ``page_id`` may be null.
    Columns other than ``page_id`` and ``url`` are not read. An empty table gives an empty result.
    """
    hit = matching_urls(pages, rules).select("url", F.lit(True).alias("hit"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), fixed)
    parsed = pages.select("page_id", "url").join(hit, "url", "left").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("hit", F.lit(False)).alias("mined"))
    other = F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))
    return parsed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), "mined")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(pages, mine_rules(pages.join(known, "page_id")))


#: The same in SQL: every combination of tokens of a bad page is counted, by bit masks over its tokens.
OP4_SQL = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id, url, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    string_split(regexp_extract(regexp_extract(rest, '^[^#]*', 0), '\\?(.*)$', 1, 's'), '&') AS fields
  FROM cut
), own AS (
  SELECT page_id, url, CASE WHEN rest IS NULL THEN [] ELSE list_distinct(
    [concat('h:', x) FOR x IN string_split(host, '.') IF x <> '']
    || [concat('p:', regexp_replace(x, '[0-9]+', '0', 'g')) FOR x IN string_split(path, '/') IF x <> '']
    || [concat('q:', split_part(x, '=', 1)) FOR x IN fields IF split_part(x, '=', 1) <> '']) END AS tokens
  FROM parsed
), labelled AS (
  SELECT row_number() OVER () AS k, tokens, quality = 0 AS bad FROM own JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL AND len(tokens) > 0
), baskets AS (SELECT DISTINCT list_sort(tokens) AS tokens FROM labelled WHERE bad
), combos AS (
  SELECT DISTINCT [tokens[i] FOR i IN range(1, len(tokens) + 1) IF (mask >> (i - 1)) & 1 = 1] AS tokens
  FROM (SELECT tokens, unnest(range(1, CAST(1 AS BIGINT) << len(tokens))) AS mask FROM baskets)
), mined AS (
  SELECT c.tokens FROM combos c JOIN labelled l ON list_has_all(l.tokens, c.tokens) GROUP BY c.tokens
  HAVING count(*) FILTER (bad) >= ceil({MIN_SUPPORT} * (SELECT count(*) FROM labelled))
    AND count(*) FILTER (bad) >= {MIN_CONFIDENCE} * count(*) AND count(*) FILTER (bad) > 0
), hits AS (
  SELECT DISTINCT url FROM own o, mined m WHERE list_has_all(o.tokens, m.tokens)
), fixed AS (
  SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}) r(verdict, host, path)
), best AS (
  SELECT p.page_id, p.url, arg_max(r.verdict, length(r.host || r.path)) AS verdict, arg_max(r.host || r.path, length(r.host || r.path)) AS rule
  FROM (SELECT DISTINCT page_id, url, host, path FROM parsed) p
  JOIN fixed r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id, p.url
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN h.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict, h.url IS NOT NULL AS mined
FROM parsed p LEFT JOIN hits h ON p.url = h.url
LEFT JOIN best b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.url = b.url
"""
