"""WARC archives and a Merkle fixity audit of their replicas.

Every record is hashed where it is. Hashes and lengths of the records of a shard, in the order of
their offsets, are hashed together in groups of ``FANOUT``, these again, up to one node per shard;
shards go to buckets by a hash of their number, and buckets in groups of ``FANOUT`` up to one root.
Each replica's tree is built from its own order, sizes and offsets. Two replicas are compared from
the root down: a level is only looked at below nodes whose hashes differ, so an intact replica
costs one comparison and a damaged one the branches that lead to the damage. A record that is
inserted or lost shifts all that follow in its shard, which are then looked at too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subsight.llm.common import landed, table

#: How a record begins, and what ends its head and itself.
FIRST_LINE, BLANK_LINE = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Children of a node; record ids in a shard.
FANOUT = 16
SHARD_IDS = 4096
#: The (first) shard of records whose id is null, and the least shard of another id that has shards of its own.
NO_ID, HOT = -(1 << 62), 1 << 61


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC/1.1 resource record; a null URL has no target line, a null body is empty."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", " "), F.lit("\r\n")), F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archive_records(pages: DataFrame) -> DataFrame:
    """``(record_id, record)`` per row of ``pages`` (``page_id, url, html``)."""
    return pages.select(F.col("page_id").cast("long").alias("record_id"), record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def hashed(records: DataFrame) -> DataFrame:
    """``(record_id, hash, size, copies)``: one row for each different record of an id.

    The hash is that of the id and of the record's sha256. Equal copies are counted before anything
    is shuffled.
    """
    rows = records.select("record_id", record_hash().alias("hash"), F.length("record").cast("long").alias("size"))
    return rows.groupBy("record_id", "hash", "size").agg(F.count("*").alias("copies"))


def record_hash() -> Column:
    return F.sha2(F.concat_ws(":", id_text(), F.sha2("record", 256)), 256)


def id_text() -> Column:
    return F.coalesce(F.col("record_id").cast("string"), F.lit("none"))


def pieces(leaves: DataFrame, shard_ids: int) -> DataFrame:
    """``leaves`` with their ``shard``; copies that go to several shards are a row for each.

    An id of more than ``shard_ids`` records has shards of its own, of so many each, in the order of
    the hashes; they are numbered from ``NO_ID`` for the null id and by a hash above ``HOT`` else.
    """
    own = F.coalesce(F.expr(f"record_id div {shard_ids}"), F.lit(NO_ID))
    hot = landed(leaves.groupBy("record_id").agg(F.sum("copies").alias("n")).where(F.col("n") > shard_ids).select(F.col("record_id").alias("hot_id")), "hot-ids")
    if hot.isEmpty():
        return leaves.withColumn("shard", own)
    same = F.col("record_id").eqNullSafe(F.col("hot_id"))
    many = leaves.join(hot, same, "left_semi").withColumn("slice", F.substring("hash", 1, 4))
    # at most 65,536 slices of an id, of about as many different records each
    earlier = Window.partitionBy("record_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = many.groupBy("record_id", "slice").agg(F.sum("copies").alias("n")).select(F.col("record_id").alias("id"), F.col("slice").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off"))
    before = Window.partitionBy("record_id", "slice").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    ranked = many.withColumn("rank", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(sliced, F.col("record_id").eqNullSafe(F.col("id")) & (F.col("slice") == F.col("of")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("off")).withColumn("part", F.explode(F.expr(f"sequence(rank div {shard_ids}, (rank + copies - 1) div {shard_ids})")))
    first, end = F.greatest("rank", F.col("part") * shard_ids), F.least(F.col("rank") + F.col("copies"), (F.col("part") + 1) * shard_ids)
    number = F.when(F.col("record_id").isNull(), F.lit(NO_ID) + F.col("part")).otherwise(F.lit(HOT) + F.xxhash64("record_id", "part").bitwiseAND(F.lit(HOT - 1)))
    spread = ranked.select("record_id", "hash", "size", (end - first).alias("copies"), number.alias("shard"))
    return leaves.join(hot, same, "left_anti").withColumn("shard", own).unionByName(spread)


def manifest(leaves: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """``(shard, seq, record_id, start, stop, hash)``: the place of each record in its shard.

    A shard has the records of ``shard_ids`` consecutive ids in the order of ids, then hashes, then
    copies; records with a null id are the shard ``NO_ID``. An id of more than ``shard_ids`` records,
    null too, is spread over shards of its own. The shards are the files of the archive.
    """
    in_shard = Window.partitionBy("shard").orderBy("record_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    put = pieces(landed(leaves, "leaves"), shard_ids)
    ahead = F.coalesce(F.sum("copies").over(in_shard), F.lit(0)).alias("ahead")
    at = F.coalesce(F.sum(F.col("copies") * F.col("size")).over(in_shard), F.lit(0)).alias("at")
    each = put.select("*", ahead, at).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    start = F.col("at") + F.col("copy") * F.col("size")
    return each.select("shard", (F.col("ahead") + F.col("copy")).alias("seq"), "record_id", start.alias("start"), (start + F.col("size")).alias("stop"), "hash")


def tree(placed: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """``(level, shard, node, hash, start, stop)``: level 0 are the records, ``depth`` has one node per shard.

    A node's hash is that of its children's hashes and sizes in their order (a null hash counts as
    such); no node has more than ``fanout`` children, however large the shard.
    """
    level = placed.select(F.lit(0).alias("level"), "shard", F.col("seq").alias("node"), "hash", "start", "stop")
    out = level
    for k in range(1, depth + 1):
        child = F.struct("node", F.concat_ws(":", F.coalesce("hash", F.lit("none")), (F.col("stop") - F.col("start")).cast("string")).alias("h"))
        level = level.groupBy("shard", F.expr(f"node div {fanout}").alias("up")).agg(
            joined(child).alias("hash"), F.min("start").alias("start"), F.max("stop").alias("stop")
        ).select(F.lit(k).alias("level"), "shard", F.col("up").alias("node"), "hash", "start", "stop")
        out = out.unionByName(level)
    return out


def shard_tree(roots: DataFrame, width: int, fanout: int = FANOUT) -> DataFrame:
    """``(level, node, hash)`` over the root nodes of shards: level 0 are ``fanout ** width`` buckets, ``width`` is one root.

    A bucket holds the shards whose numbers hash to it, so a shard that only one replica has moves no other.
    """
    bucket = F.pmod(F.xxhash64("shard"), F.lit(fanout**width))
    own = F.struct("shard", F.concat_ws(":", "shard", "hash").alias("h"))
    level = roots.groupBy(bucket.alias("node")).agg(joined(own).alias("hash")).select(F.lit(0).alias("level"), "node", "hash")
    out = level
    for k in range(1, width + 1):
        child = F.struct("node", F.concat_ws(":", "node", "hash").alias("h"))
        level = level.groupBy(F.expr(f"node div {fanout}").alias("up")).agg(joined(child).alias("hash")).select(F.lit(k).alias("level"), F.col("up").alias("node"), "hash")
        out = out.unionByName(level)
    return out


def joined(child: Column) -> Column:
    """The hash of the ``h`` of the children in their order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["h"]), "/"), 256)


def own_manifest(replica: DataFrame) -> DataFrame:
    """Like ``manifest``, of records at the places they have (``shard, at``), with ``leaf``: the hash for the tree.

    Where a record does not start at the end of the one before it, ``leaf`` also stands for how far
    it is off.
    """
    in_shard = Window.partitionBy("shard").orderBy("at", "hash")
    rows = replica.select(F.coalesce("shard", F.lit(NO_ID)).alias("shard"), "record_id", record_hash().alias("hash"), F.length("record").cast("long").alias("size"), F.col("at").cast("long").alias("at"))
    rows = rows.select(
        "*", (F.row_number().over(in_shard) - 1).cast("long").alias("seq"), F.coalesce(F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    )
    off = F.sha2(F.concat_ws(":", "hash", F.coalesce((F.col("at") - F.col("ahead")).cast("string"), F.lit("none"))), 256)
    leaf = F.when(F.col("at").eqNullSafe(F.col("ahead")), F.col("hash")).otherwise(off)
    return rows.select("shard", "seq", "record_id", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop"), "hash", leaf.alias("leaf"))


def depth_for(nodes: int, fanout: int = FANOUT) -> int:
    """Levels above the records until one node is left."""
    depth = 1
    while nodes > fanout:
        nodes, depth = -(-nodes // fanout), depth + 1
    return depth


def differing(good: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """The ``keys`` at which the hashes of two trees differ, or that only one of them has."""
    held = bad.select(*keys, F.col("hash").alias("held"))
    return good.select(*keys, "hash").join(held, keys, "full").where(~F.col("hash").eqNullSafe(F.col("held"))).select(*keys)


def beyond(rows: DataFrame, key: str, allowed: str) -> DataFrame:
    """The rows of each ``key`` after its first ``allowed`` ones, in the order of their places.

    They are numbered by shard, so that a key of very many rows is not put in order in one task.
    """
    earlier = Window.partitionBy(key).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "shard").agg(F.count("*").alias("n")).select(key, "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "shard").orderBy("seq")))
    return ranked.join(counts, [key, "shard"]).where(F.col("off") + F.col("rank") > F.col(allowed)).drop("rank", "off")


def audit(records: DataFrame, replica: DataFrame, shard_ids: int = SHARD_IDS, fanout: int = FANOUT, lies: bool = False) -> DataFrame:
    """``(record_id, shard, seq, start, stop, status)`` of every record that a replica doesn't hold as it is listed.

    Both tables have ``record_id`` and ``record`` (bytes; a null record counts as none). ``status`` is
    ``missing`` where the replica has no record of the id, ``changed`` where it has one, but not this
    or fewer copies of it, or ``extra`` for each record that is neither listed nor stands for a
    changed one (it has no place: nulls). With ``lies`` the replica is audited as it lies: its columns
    ``shard`` and ``at`` (offset) are those of ``read_archive``, and records that it holds at another
    place are ``moved``. Else it has no order of its own and is placed like the listed one, whatever
    columns it has. Every record and every copy is audited by itself; which of equal copies are lost
    can't be told, so the last ones are reported. Intact records give no row; two empty tables give an
    empty result. Other columns are not read.
    """
    usable = F.col("record").isNotNull()
    listed = landed(manifest(hashed(records.where(usable)), shard_ids), "manifest")
    held = replica.where(usable)
    other = landed(own_manifest(held) if lies else manifest(hashed(held), shard_ids).withColumn("leaf", F.col("hash")), "replica")
    ends = listed.select("shard", "seq").unionByName(other.select("shard", "seq")).agg(F.max("seq"), F.count(F.when(F.col("seq") == 0, 1))).first()
    depth, width = depth_for((ends[0] or 0) + 1, fanout), depth_for(ends[1], fanout)
    good = landed(tree(listed, depth, fanout), "tree")
    bad = landed(tree(other.drop("hash").withColumnRenamed("leaf", "hash"), depth, fanout), "tree")
    top = F.col("level") == depth
    good_top, bad_top = (landed(shard_tree(t.where(top), width, fanout), "shard-tree") for t in (good, bad))
    roots = [[r["hash"] for r in t.where(F.col("level") == width).select("hash").collect()] for t in (good_top, bad_top)]
    if roots[0] == roots[1]:
        return listed.limit(0).select("record_id", "shard", "seq", "start", "stop", F.lit("").alias("status"))
    looked_at = None
    for level in range(width, -1, -1):
        a, b = (t.where(F.col("level") == level) for t in (good_top, bad_top))
        if looked_at is not None:
            above = looked_at.select(F.col("node").alias("up"))
            a, b = (t.withColumn("up", F.expr(f"node div {fanout}")).join(above, "up", "left_semi") for t in (a, b))
        looked_at = landed(differing(a, b, ["node"]), "differing")
    buckets = looked_at.select(F.col("node").alias("bucket"))
    looked_at = None
    for level in range(depth, -1, -1):
        a, b = (t.where(F.col("level") == level) for t in (good, bad))
        if looked_at is None:
            a, b = (t.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(fanout**width))).join(buckets, "bucket", "left_semi") for t in (a, b))
        else:
            above = looked_at.select("shard", F.col("node").alias("up"))
            a, b = (t.withColumn("up", F.expr(f"node div {fanout}")).join(above, ["shard", "up"], "left_semi") for t in (a, b))
        looked_at = landed(differing(a, b, ["shard", "node"]), "differing")
    places = looked_at.withColumnRenamed("node", "seq")
    mine, theirs = (t.join(places, ["shard", "seq"], "left_semi").withColumn("id", id_text()) for t in (listed, other))
    both = mine.select("hash", F.lit(1).alias("m"), F.lit(0).alias("t")).unionByName(theirs.select("hash", F.lit(0).alias("m"), F.lit(1).alias("t")))
    uneven = landed(both.groupBy("hash").agg(F.sum("m").alias("listed"), F.sum("t").alias("held")).where("listed <> held"), "uneven")
    lost = landed(beyond(mine.join(uneven.where("listed > held"), "hash"), "hash", "held"), "lost")
    stray = beyond(theirs.join(uneven.where("held > listed"), "hash"), "hash", "listed").drop("listed", "held")
    gone = lost.groupBy("id").agg(F.count("*").alias("n"))
    there = other.select(id_text().alias("id")).join(gone, "id", "left_semi").distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("there"), "changed").otherwise("missing")
    damaged = lost.join(there, "id", "left").select("record_id", "shard", "seq", "start", "stop", status.alias("status"))
    if lies:
        moved = mine.join(lost, ["shard", "seq"], "left_anti")
        damaged = damaged.unionByName(moved.select(*damaged.columns[:-1], F.lit("moved").alias("status")))
    nothing = F.lit(None).cast("long")
    extra = beyond(landed(stray.join(gone, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))), "stray"), "id", "n")
    return damaged.unionByName(extra.select("record_id", *[nothing.alias(c) for c in ("shard", "seq", "start", "stop")], F.lit("extra").alias("status")))


def write_archive(records: DataFrame, folder: str, shard_ids: int = SHARD_IDS) -> None:
    """Write the records as WARC files, one for each shard, in the order and at the offsets of the manifest.

    Equal records are written once, null records not at all; an empty table has no files. Records end with a line end, which is the one that Spark's text writer adds.
    """
    placed = manifest(hashed(records), shard_ids).select("hash", "shard", "seq")
    rows = records.select(record_hash().alias("hash"), "record").dropDuplicates(["hash"]).join(placed, "hash")
    body = F.substring("record", F.lit(1), F.length("record") - 1).cast("string").alias("value")
    rows.repartition("shard").sortWithinPartitions("shard", "seq").select(body, "shard").write.mode("errorifexists").partitionBy("shard").text(folder)


def split_archive(data: bytes) -> Iterator[tuple[int, int, int | None]]:
    """``(start, end, record id)`` of each record of a WARC file, damaged ones too; ends meet the next starts.

    A record's length is believed if two of three signs agree with it: a record begins here, it ends as
    one should, another (or nothing) follows. Otherwise the record goes up to the next line that
    begins one. An id that can't be read is None.
    """
    at = 0
    while at < len(data):
        head = data.find(BLANK_LINE, at)
        fields = dict(line.split(b": ", 1) for line in data[at : max(head, at)].split(b"\r\n")[1:] if b": " in line)
        size, name = fields.get(b"Content-Length", b""), fields.get(b"WARC-Record-ID", b"")[10:-1]
        end = head + 8 + int(size) if head >= 0 and size.isdigit() and len(size) < 19 else -1
        signs = data.startswith(FIRST_LINE, at) + (data[end - 4 : end] == BLANK_LINE) + (end == len(data) or data.startswith(FIRST_LINE, end))
        if not (at < end <= len(data) and signs >= 2):
            following = data.find(BLANK_LINE + FIRST_LINE, at)
            end = following + 4 if following >= 0 else len(data)
        yield at, end, int(name) if name.removeprefix(b"-").isdigit() and len(name) < 20 else None
        at = end


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``(record_id, record, shard, at)`` of the records of WARC files of at most 2 GB each.

    A damaged record comes with the bytes that it has (and a null id, where that is damaged); the
    records behind it are read all the same. An empty folder of files gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                shard = int(path.rsplit("shard=", 1)[1].split("/", 1)[0])
                rows = [(name, data[at:end], shard, at) for at, end, name in split_archive(data)]
                types = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                columns = zip(*rows, strict=True) if rows else ([],) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["record_id", "record", "shard", "at"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(run, "record_id long, record binary, shard long, at long")


def damaged_replica(records: DataFrame) -> DataFrame:
    """The records as a second site might hold them, for the query: some have a wrong byte, some are lost, some are stray."""
    rot = F.overlay(F.col("record"), F.encode(F.lit("#"), "UTF-8"), F.lit(12))
    held = records.where(F.coalesce(F.pmod("record_id", F.lit(101)) != 50, F.lit(True)))
    changed = held.withColumn("record", F.when(F.pmod("record_id", F.lit(97)) == 13, rot).otherwise(F.col("record")))
    stray = records.where(F.pmod("record_id", F.lit(103)) == 7).withColumn("record_id", -1 - F.col("record_id"))
    return changed.unionByName(stray)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_records(table(spark, sf_dir, "pages"))
    return audit(records, damaged_replica(records))


OP9_SQL = f"""
WITH records AS (
  SELECT page_id, strlen(concat('WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:', page_id, '>\r\n',
    CASE WHEN url IS NULL THEN '' ELSE concat('WARC-Target-URI: ', regexp_replace(url, '[\r\n]', ' ', 'g'), '\r\n') END,
    'Content-Type: text/html\r\nContent-Length: ', strlen(coalesce(html, '')), '\r\n\r\n', coalesce(html, ''), '\r\n\r\n')) AS size
  FROM pages
), placed AS (
  SELECT page_id, page_id // {SHARD_IDS} AS shard, row_number() OVER w - 1 AS seq,
    CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop, size
  FROM records WINDOW w AS (PARTITION BY page_id // {SHARD_IDS} ORDER BY page_id)
)
SELECT page_id AS record_id, shard, seq, stop - size AS start, stop, CASE WHEN page_id % 101 = 50 THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE page_id % 101 = 50 OR page_id % 97 = 13
UNION ALL SELECT -1 - page_id, NULL, NULL, NULL, NULL, 'extra' FROM pages WHERE page_id % 103 = 7
"""
