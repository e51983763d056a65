"""The Merkle audit against a plain comparison, its descent, and the files byte by byte."""

import hashlib
from pathlib import Path

import duckdb
import pytest

from subsight.llm import warc
from subsight.session import scratch_table_path

SMALL = "/root/testdata/sf0.01"


def plain_record(page_id, url, html):
    body = (html or "").encode()
    target = f"WARC-Target-URI: {url}\r\n" if url is not None else ""
    name = "none" if page_id is None else page_id
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{name}>\r\n{target}Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_query_against_plain_comparison_and_sql(spark):
    pages = sorted(map(tuple, spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()))
    want, ends, seqs = set(), {}, {}
    for k, url, html in pages:
        shard, record = k // warc.SHARD_IDS, plain_record(k, url, html)
        start, seq = ends.get(shard, 0), seqs.get(shard, 0)
        ends[shard], seqs[shard] = start + len(record), seq + 1
        if k % 101 == 50 or k % 97 == 13:
            want.add((k, shard, seq, start, ends[shard], "missing" if k % 101 == 50 else "changed"))
        if k % 103 == 7:
            want.add((-1 - k, None, None, None, None, "extra"))
    assert {tuple(r) for r in warc.op9_warc(spark, SMALL).collect()} == want and len(want) > 3
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    assert set(con.execute(warc.OP9_SQL).fetchall()) == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id long, record binary")


def status(df):
    return {(r["record_id"], r["status"]) for r in df.collect()}


def test_audit_of_odd_tables(spark):
    a = frame(spark, [(1, b"a"), (2, b"b"), (2, b"b"), (3, b""), (None, b"n"), (None, b"m"), (5, None), (-9, b"x"), (900, b"z" * 300000)])
    assert warc.audit(a, a).collect() == []
    same = frame(spark, [(900, b"z" * 300000), (None, b"m"), (2, b"b"), (3, b""), (None, b"n"), (2, b"b"), (1, b"a"), (-9, b"x")])
    assert warc.audit(a, same, shard_ids=4, fanout=2).collect() == []
    b = frame(spark, [(1, b"A"), (2, b"b"), (3, b""), (None, b"n"), (5, b"now"), (-9, b"x")])
    assert status(warc.audit(a, b, shard_ids=4, fanout=2)) == {(1, "changed"), (2, "changed"), (None, "changed"), (5, "extra"), (900, "missing")}
    none = frame(spark, [])
    assert warc.audit(none, none).collect() == []
    assert status(warc.audit(none, frame(spark, [(None, b"x")]))) == {(None, "extra")}
    assert status(warc.audit(frame(spark, [(4, b"x")]), none)) == {(4, "missing")}


def test_nodes_are_hashes_of_their_children(spark):
    records = frame(spark, [(k, bytes([k]) * (k + 1)) for k in range(30)])
    nodes = {(r["level"], r["shard"], r["node"]): r for r in warc.tree(warc.manifest(warc.hashed(records), 20), 3, 3).collect()}
    assert max(n for lv, _, n in nodes if lv == 3) == 0
    for (level, shard, node), r in nodes.items():
        if level:
            below = [nodes[level - 1, shard, c] for c in range(3 * node, 3 * node + 3) if (level - 1, shard, c) in nodes]
            text = "/".join(f"{c['hash']}:{c['stop'] - c['start']}" for c in below)
            assert r["hash"] == hashlib.sha256(text.encode()).hexdigest()
            assert (r["start"], r["stop"]) == (below[0]["start"], below[-1]["stop"])
        elif node > 0:
            assert r["start"] == nodes[0, shard, node - 1]["stop"]


def test_archive_files(spark):
    pages = [(1, "http://a/\r\nx", "<p>é"), (2, None, None), (3, "u", "\r\n\r\nWARC/1.1"), (None, "n", "h"), (5000, "v", "x" * 100000)]
    df = spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, record int")
    records = warc.archive_records(df)
    folder = scratch_table_path(spark, "test-warc")
    warc.write_archive(records, folder)
    back = {r["record_id"]: bytes(r["record"]) for r in warc.read_archive(spark, folder).collect()}
    assert back == {k: plain_record(k, u and u.replace("\r", " ").replace("\n", " "), h) for k, u, h in pages}
    assert warc.audit(records, warc.read_archive(spark, folder), lies=True).collect() == []
    places = {(r["shard"], r["at"], r["record_id"]) for r in warc.read_archive(spark, folder).collect()}
    assert places == {(r["shard"], r["start"], r["record_id"]) for r in warc.manifest(warc.hashed(records)).collect()}
    (file,) = Path(folder, "shard=1").glob("part-*")
    file.write_bytes(file.read_bytes().replace(b"xxxx", b"xxyx", 1))
    Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)
    assert status(warc.audit(records, warc.read_archive(spark, folder), lies=True)) == {(5000, "changed")}


def test_every_copy_of_a_hot_id_has_its_own_place(spark):
    # one id and the null id hold most rows, with copies; each damaged or lost one is located by itself
    rows = [(7, b"h%d" % (k % 40)) for k in range(60)] + [(None, b"n%03d" % k) for k in range(30)] + [(k, b"u%d" % k) for k in range(20, 30)]
    a = frame(spark, rows)
    placed = warc.manifest(warc.hashed(a), 8).collect()
    assert len(placed) == len(rows)
    shards = {}
    for r in placed:
        shards.setdefault(r["shard"], []).append((r["seq"], r["start"], r["stop"]))
    assert max(map(len, shards.values())) <= 8
    for places in shards.values():
        places.sort()
        assert [p[0] for p in places] == list(range(len(places)))
        assert [p[1] for p in places] == [0] + [p[2] for p in places[:-1]]
    assert warc.audit(a, frame(spark, rows[::-1]), shard_ids=8, fanout=2).collect() == []
    held = list(rows)
    held[3], held[70] = (7, b"bad"), (None, b"bad")
    for gone in (b"h25", b"h5"):
        held.remove((7, gone))
    held += [(7, b"h1"), (None, b"new")]
    got = warc.audit(a, frame(spark, held), shard_ids=8, fanout=2).collect()
    hashes = {(r["shard"], r["seq"]): (r["record_id"], r["stop"] - r["start"], r["hash"]) for r in placed}
    digest = {r["hash"]: bytes(r["record"]) for r in a.select("record", warc.record_hash().alias("hash")).collect()}
    lost = sorted((str(r["record_id"]), digest[hashes[r["shard"], r["seq"]][2]], r["status"]) for r in got if r["status"] != "extra")
    assert lost == sorted([("7", b"h3", "changed"), ("7", b"h25", "changed"), ("7", b"h5", "changed"), ("None", b"n010", "changed")])
    assert all(r["stop"] - r["start"] == hashes[r["shard"], r["seq"]][1] for r in got if r["status"] != "extra")
    # of id 7 two strays (bad, h1) stand for two of the three lost; of the null id one for one, one is left
    assert [(r["record_id"], r["shard"]) for r in got if r["status"] == "extra"] == [(None, None)]


def test_archive_of_copies_and_hot_ids(spark):
    pages = [(7, "u", f"h{k % 9}") for k in range(20)] + [(None, "n", f"x{k}") for k in range(11)] + [(k, "v", "w") for k in range(5)]
    records = warc.archive_records(spark.createDataFrame(pages, "page_id long, url string, html string"))
    folder = scratch_table_path(spark, "test-warc-hot")
    warc.write_archive(records, folder, 4)
    back = warc.read_archive(spark, folder)
    key = "shard", "start", "record_id"
    assert sorted(map(str, back.select("shard", back["at"].alias("start"), "record_id").collect())) == sorted(map(str, warc.manifest(warc.hashed(records), 4).select(*key).collect()))
    assert warc.audit(records, back, shard_ids=4, lies=True).collect() == []


def test_replica_is_audited_as_it_lies(spark):
    listed = frame(spark, [(k, b"r%02d" % k) for k in range(48)])
    files = {f: list(range(8 * f, 8 * f + 8)) for f in range(6)}

    def found(gap_before):
        rows = []
        for shard, ids in files.items():
            at = 0
            for k in ids:
                at += k == gap_before
                rows.append((k, b"r%02d" % k, shard, at))
                at += 3
        return status(warc.audit(listed, spark.createDataFrame(rows[::-1], "record_id long, record binary, shard long, at long"), shard_ids=8, lies=True))

    assert found(None) == set()
    files[0].insert(2, files[0].pop(3))
    files[1].insert(5, 99)
    files[4].append(files[3].pop())
    files[5].remove(45)
    moved = {2, 3, 13, 14, 15, 22, 23, 31, 46, 47}
    assert found(22) == {(k, "moved") for k in moved} | {(99, "extra"), (45, "missing")}


def six_records():
    return [plain_record(k, f"http://a/{k}", f"<p>{k}\r\n\r\nbody WARC/1.1\r\n of {k}") for k in range(1, 7)]


def test_a_damaged_record_leaves_the_others_whole():
    records = six_records()
    starts = [sum(map(len, records[:k])) for k in range(7)]
    whole = b"".join(records)
    assert [(a, b) for a, b, _ in warc.split_archive(whole)] == list(zip(starts, starts[1:]))
    for at in range(starts[2], starts[3]):
        for other in (b"#", b"0", b"9", b"\n"):
            data = whole[:at] + other + whole[at + 1 :]
            found = [data[a:b] for a, b, _ in warc.split_archive(data)]
            assert b"".join(found) == data
            assert [r for r in records[:2] + records[3:] if r not in found] == [], (at, other)
    for cut in range(len(whole)):  # a file that ends early
        assert b"".join(whole[a:b] for a, b, _ in warc.split_archive(whole[:cut])) == whole[:cut]
    assert list(warc.split_archive(b"")) == [] and [x[:2] for x in warc.split_archive(b"\0" * 9)] == [(0, 9)]


@pytest.mark.parametrize("what", [b"WARC/1.1", b"Length: ", b"<p>"])
def test_one_wrong_byte_is_one_damaged_record(spark, what):
    pages = [(k, f"http://a/{k}", f"<p>{k}") for k in range(1, 7)]
    records = warc.archive_records(spark.createDataFrame(pages, "page_id long, url string, html string"))
    folder = scratch_table_path(spark, "test-warc-byte")
    warc.write_archive(records, folder)
    (file,) = Path(folder, "shard=0").glob("part-*")
    data = file.read_bytes()
    at = data.index(what, data.index(b"page:3>") - 60 if what.startswith(b"WARC") else data.index(b"page:3>")) + len(what) - (0 if what == b"Length: " else 1)
    file.write_bytes(data[:at] + b"#" + data[at + 1 :])
    Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)
    assert status(warc.audit(records, warc.read_archive(spark, folder), lies=True)) == {(3, "changed")}


def test_columns_of_the_replica_do_not_choose_the_audit(spark):
    rows = [(k, b"r%02d" % k) for k in range(20)]
    odd = spark.createDataFrame([(k, r, 7, 3) for k, r in rows], "record_id long, record binary, shard long, at long")
    assert warc.audit(frame(spark, rows), odd, shard_ids=8).collect() == []


def test_roots_are_compared_first_and_ids_count(spark, monkeypatch):
    a = frame(spark, [(1, b"x"), (200, b"y"), (None, b"z")])
    assert status(warc.audit(a, frame(spark, [(1, b"x"), (201, b"y"), (None, b"z")]), shard_ids=8)) == {(200, "missing"), (201, "extra")}

    def never(*_):
        raise AssertionError("descended")

    monkeypatch.setattr(warc, "differing", never)
    assert warc.audit(a, a, shard_ids=8).collect() == []
