"""Merkle manifest of a dataset: a digest for each row, a tree for each partition of it, proofs for all rows.

Rows are leaves. The leaves of one tree stand in the order of their ids; every two consecutive
nodes become one until one is left. The roots of the trees are the leaves of a last tree.

Only every ``BAND``-th level is written. A node of a stored level and the up to 2 ** ``BAND`` stored
nodes below it are an aligned subtree: building goes up by one aggregate for each stored level.
Proofs are taken on the way down: each subtree regenerates the levels between from its stored
descendants, gives every descendant its siblings, and drops the rest again.

No node is ever in a task with more than one aligned subtree at a time, and places come from counts
of range partitions, so a tree may hold all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subsight.llm.common import landed, table

#: Levels from one stored level to the next.
BAND = 8
#: Where this divides the unsigned crc32 of the decimal id, the audit tampers with the row.
TAMPER = 7


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, fields)), "UTF-8"), 256)


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (``tree`` and more columns) with ``i``, their place in the tree by ``order``, and ``n``, its size.

    Range partitions are sorted, rows numbered in them, and the numbers moved by what the partitions
    before hold of the tree: no task holds more than its range, whatever the size of a tree.
    """
    by = ["tree", *order]
    ranged = nodes.repartitionByRange(_ranges(nodes), *by).sortWithinPartitions(*by)
    numbered = landed(ranged.withColumn("_at", F.monotonically_increasing_id()), name)  # partition above 33 bits, row below
    part = F.shiftright("_at", 33)
    counts = numbered.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    per_tree = Window.partitionBy("tree")  # a row for each range partition that has rows of the tree
    before = F.sum("_rows").over(per_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("tree").alias("_tree"), "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(per_tree).alias("n"))
    joined = numbered.withColumn("_own", part).join(counts, (F.col("tree") == F.col("_tree")) & (F.col("_own") == F.col("_part")))
    return joined.select(*nodes.columns, (F.col("_at") + F.col("_shift")).alias("i"), "n")


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def levels_above(digests: list[str], height: int) -> list[list[str]]:
    """``digests`` and the ``height`` levels above them; a lone last node is hashed alone."""
    levels = [digests]
    for _ in range(height):
        low = levels[-1]
        levels.append([digest("".join(low[k : k + 2])) for k in range(0, len(low), 2)])
    return levels


def siblings(levels: list[list[str]], k: int) -> str:
    """The other nodes of the runs above node ``k`` of the lowest level, level by level."""
    out = []
    for level in levels[:-1]:
        if (other := k ^ 1) < len(level):
            out.append(level[other])
        k >>= 1
    return "".join(out)


def height_of(n: int) -> int:
    return (n - 1).bit_length()


def fold(start: str, proof: str, path: list[tuple[int, int]]) -> str:
    """The root that ``start`` and its siblings give; ``path`` has place and tree size of each tree on the way."""
    at, found = 0, start
    for k, n in path:
        while n > 1:
            if (k ^ 1) < n:
                other = proof[at : at + 64]
                at += 64
                found = digest(other + found if k & 1 else found + other)
            else:
                found = digest(found)
            k, n = k >> 1, n + 1 >> 1
    return found


def _subtrees(nodes: DataFrame, level: int) -> DataFrame:
    """A row for each aligned subtree over the nodes of a stored level: ``tree, i, n, below`` (its nodes in order)."""
    held = F.sort_array(F.collect_list(F.struct("i", "digest")))  # 2 ** BAND at most
    rows = nodes.groupBy("tree", F.shiftright("i", BAND).alias("i"), "n").agg(held.alias("below"))
    return rows.select("tree", "i", "n", F.col("below.digest").alias("below"))


def _steps(n: int, level: int) -> int:
    """Levels from ``level`` to the next stored one, or to the root of a tree of ``n``."""
    return max(0, min(BAND, height_of(n) - level))


def _rooted(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("n").to_pylist(), batch.column("below").to_pylist(), strict=True)
            top = [levels_above(below, _steps(n, level))[-1][0] for n, below in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", "i", "n")), pa.array(top, pa.string())], ["tree", "i", "n", "digest"])

    return run


def stored_levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The stored levels of all trees over ``nodes`` (``tree, i, n, digest``), from the leaves up.

    A tree is in every level up to the one that is its root.
    """
    levels = [nodes.select("tree", "i", "n", "digest")]
    tallest = nodes.agg(F.max("n")).first()[0] or 0
    while tallest > 1 and height_of(tallest) > BAND * (len(levels) - 1):
        level = BAND * (len(levels) - 1)
        going_on = levels[-1].where(F.col("n") > (1 << level)) if level else levels[-1].where("n > 1")
        up = _subtrees(going_on, level).mapInArrow(_rooted(level), "tree string, i long, n long, digest string")
        levels.append(landed(up, f"{name}-{level + BAND}"))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``(tree, digest, n)`` of every tree: where its stored levels end."""
    parts = []
    for k, level in enumerate(levels):
        low, high = (1 << BAND * (k - 1)) if k else 0, 1 << BAND * k
        parts.append(level.where((F.col("n") > low) & (F.col("n") <= high)).select("tree", "digest", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _extracted(level: int):
    """Subtrees with the proof of their top node to their lowest nodes with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"tree": [], "i": [], "proof": []}
            for tree, i, n, below, above in zip(*(batch.column(c).to_pylist() for c in ("tree", "i", "n", "below", "proof")), strict=True):
                between = levels_above(below, _steps(n, level))
                out["tree"] += [tree] * len(below)
                out["i"] += range(i << BAND, (i << BAND) + len(below))
                out["proof"] += [siblings(between, k) + above for k in range(len(below))]
            yield pa.RecordBatch.from_arrays([pa.array(out["tree"], pa.string()), pa.array(out["i"], pa.int64()), pa.array(out["proof"], pa.string())], ["tree", "i", "proof"])

    return run


def proofs(levels: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """``(tree, i, proof)`` of every leaf; ``above`` has ``(tree, proof)``: how each tree's root goes on."""
    ends = roots(levels).select("tree", "n").join(above, "tree")
    found = None
    for k in range(len(levels) - 1, -1, -1):
        low, high = (1 << BAND * (k - 1)) if k else 0, 1 << BAND * k
        own = ends.where((F.col("n") > low) & (F.col("n") <= high)).select("tree", F.lit(0).cast("long").alias("i"), "proof")  # root: node 0
        found = own if found is None else own.unionByName(found)
        if k:
            found = landed(found, f"{name}-proofs-{BAND * k}")
            level = BAND * (k - 1)
            going_on = levels[k - 1].where(F.col("n") > max(1, 1 << level))
            found = _subtrees(going_on, level).join(found, ["tree", "i"]).mapInArrow(_extracted(level), "tree string, i long, proof string")
    return found


def manifest(rows: DataFrame, name: str = "manifest") -> DataFrame:
    """The manifest of ``rows``: a ``leaf`` digest each, the ``tree`` it belongs to, the columns of its order, and others.

    ``rows`` needs ``tree`` (string), ``digest`` and ``at`` (a column that tells equal rows apart);
    order is by all columns of ``rows`` named in ``ORDER``. Result: ``rows`` with ``i`` and ``n`` (place in and
    size of the tree), ``top_i`` and ``top_n`` (the same of the tree's root in the last tree), ``subroot``,
    ``root`` and ``proof`` (siblings up to the root). An empty table has an empty manifest.
    """
    leaves = landed(placed(rows, ORDER, f"{name}-ranges"), f"{name}-leaves")
    levels = stored_levels(leaves, name)
    subroots = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    top = landed(placed(subroots, ["of"], f"{name}-top-ranges"), f"{name}-top")
    top_levels = stored_levels(top, f"{name}-top")
    root = roots(top_levels).select("tree", F.col("digest").alias("root"))
    top_proofs = proofs(top_levels, root.select("tree", F.lit("").alias("proof")), f"{name}-top")
    told = landed(
        top.join(top_proofs, ["tree", "i"])
        .join(root, "tree")
        .select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("i").alias("top_i"), F.col("n").alias("top_n"), "proof"),
        f"{name}-told",
    )
    found = proofs(levels, told.select("tree", "proof"), name)
    return leaves.join(found, ["tree", "i"]).join(told.drop("proof"), "tree")


#: The order of the leaves in a tree: by id, then by digest, then as they come (equal digests may change places).
ORDER = ["id", "digest", "at"]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shown", "proof", "i", "n", "top_i", "top_n", "root")]
        folded, hashed, equal = [], [], []
        for start, proof, i, n, top_i, top_n, root in zip(*columns, strict=True):
            folded.append(fold(start, proof, [(i, n), (top_i, top_n)]))
            hashed.append(digest(proof))
            equal.append(folded[-1] == root)
        own = [batch.column(c) for c in ("id", "digest", "subroot", "root")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(hashed, pa.string()), pa.array(folded, pa.string()), pa.array(equal, pa.bool_())], RESULT_NAMES)


RESULT_NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def audit(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """The manifest of ``docs``, and each row checked against it: one row of ``RESULT`` for each row.

    A leaf is the digest of ``doc_id, source, lang, n_chars, text``; nulls have their own mark, so
    a null and an empty text differ. Rows of one ``lang`` (null: one of its own) are a tree, in the
    order of ``doc_id`` (null first), equal ids in the order of their leaves. ``shown`` is the number of
    characters that the checked copy shows (default: its own); the copy's root is folded from that
    row and the manifest's siblings. Repeated rows have a leaf each; other columns are not read; an
    empty table gives an empty result.
    """
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    shown = values[3] if shown is None else shown
    rows = landed(
        docs.select(
            F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("tree"),
            F.col("doc_id").cast("long").alias("id"),
            leaf(*values).alias("digest"),
            leaf(*values[:3], shown, values[4]).alias("shown"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "manifest-rows",
    )
    return manifest(rows).select("id", "digest", "shown", "proof", "i", "n", "top_i", "top_n", "subroot", "root").mapInArrow(_verified, RESULT)


def tampered() -> Column:
    """``n_chars`` of the checked copy: one more where ``TAMPER`` divides the crc32 of the id; nulls stay."""
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % TAMPER == 0
    return F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), tampered())


#: The contract in plain SQL: all levels at once, and each row folded level by level.
OP12_SQL = f"""
WITH RECURSIVE documents_crc AS (
  SELECT *, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1],
      lambda x, one: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), CAST(4294967295 AS BIGINT)) AS inverted
  FROM documents
), texts AS (
  SELECT doc_id, lang, n_chars, 4294967295 - inverted AS crc,
    concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-')) AS head,
    coalesce(concat(strlen(text), ':', text), '-') AS tail
  FROM documents_crc
), copies AS (
  SELECT *, CASE WHEN crc % {TAMPER} = 0 THEN n_chars + 1 ELSE n_chars END AS shown_chars FROM texts
), leaves AS (
  SELECT doc_id, lang, sha256(concat(head, coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-'), tail)) AS leaf,
    sha256(concat(head, coalesce(concat(strlen(CAST(shown_chars AS VARCHAR)), ':', shown_chars), '-'), tail)) AS shown
  FROM copies
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT lang, level + 1, i // 2, (min(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2
), subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (min(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2
), others AS (
  SELECT lang, level, i, n, digest FROM nodes
  UNION ALL
  SELECT s.lang, 1000 + t.level, t.i, t.n, t.digest FROM tops t, (SELECT DISTINCT lang FROM leaves) s
), walk AS (
  SELECT r.doc_id, r.lang, r.leaf, s.digest AS subroot, s.i AS top_i, s.n AS top_n, 0 AS level, r.i, r.n, r.shown AS folded, '' AS proof
  FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.subroot, w.top_i, w.top_n,
    CASE WHEN w.n > 1 THEN w.level + 1 ELSE 1000 END, CASE WHEN w.n > 1 THEN w.i // 2 ELSE w.top_i END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE w.top_n END,
    CASE WHEN w.n = 1 THEN w.folded WHEN o.digest IS NULL THEN sha256(w.folded) WHEN w.i % 2 = 1 THEN sha256(concat(o.digest, w.folded)) ELSE sha256(concat(w.folded, o.digest)) END,
    CASE WHEN w.n > 1 THEN concat(w.proof, o.digest) ELSE w.proof END
  FROM walk w LEFT JOIN others o ON o.lang IS NOT DISTINCT FROM w.lang AND o.level = w.level AND o.i = xor(w.i, 1)
  WHERE w.n > 1 OR w.level < 1000
)
SELECT w.doc_id, w.leaf, w.subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM walk w, (SELECT digest FROM tops WHERE n = 1) t WHERE w.level >= 1000 AND w.n = 1
"""
