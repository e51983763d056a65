"""CSV of several layouts, batch and stream, replaced tables that survive failed writes, and reconciled loads."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from subsight.sources import sinks, staging
from subsight.sources.sinks import VersionedTable
from subsight.streaming.ingest import land_csv, rejects_path

TWO_ORDERS = {
    "a.csv": "customer_id,signup_date,segment,country,is_enterprise\nC1,2023-01-01,SMB,UK,True\nshort,line\n",
    "b.csv": "segment,extra,customer_id,is_enterprise,signup_date,country\nENT,x,C2,False,2023-02-02,NA\n",
    "c[1]{x} y.csv": "is_enterprise,country,segment,signup_date,customer_id\n0,US,,2023-03-03,C3\n",
    "d.csv": "",
}
WANT = {("C1", "2023-01-01", "SMB", "UK", "True"), ("C2", "2023-02-02", "ENT", "NA", "False"), ("C3", "2023-03-03", None, "US", "0")}


def drop(folder, files=TWO_ORDERS):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    return str(folder)


def test_a_folder_of_two_column_orders(spark, tmp_path):
    folder = drop(tmp_path / "in")
    assert {tuple(r) for r in staging.read_staging_csv(spark, folder, "customers").collect()} == WANT
    assert [r["line"] for r in staging.csv_rejects(spark, folder, "customers").collect()] == ["short,line"]
    assert len(staging.csv_layouts(spark, folder)) == 3


def test_a_file_without_a_column_and_a_folder_without_rows(spark, tmp_path):
    folder = drop(tmp_path / "in", TWO_ORDERS | {"e.csv": "customer_id,segment\nC4,SMB\n"})
    with pytest.raises(ValueError, match="e.csv has no column signup_date, country, is_enterprise"):
        staging.read_staging_csv(spark, folder, "customers")
    empty = drop(tmp_path / "empty", {"d.csv": ""})
    assert staging.read_staging_csv(spark, empty, "customers").collect() == []
    header = drop(tmp_path / "header", {"h.csv": "customer_id,signup_date,segment,country,is_enterprise\n"})
    assert staging.read_staging_csv(spark, header, "customers").collect() == []


def test_the_stream_lands_by_name_and_keeps_rejects(spark, tmp_path):
    out, ckpt, folder = str(tmp_path / "out"), str(tmp_path / "ckpt"), drop(tmp_path / "in")
    land_csv(spark, folder, "customers", out, ckpt, max_files_per_trigger=1).awaitTermination()
    read = lambda: {tuple(r) for r in spark.read.parquet(out).drop("batch").collect()}
    assert read() == WANT
    assert [r["line"] for r in spark.read.parquet(rejects_path(out)).collect()] == ["short,line"]
    drop(tmp_path / "in", {"z.csv": "country,is_enterprise,customer_id,signup_date,segment\nDE,1,C9,2023-04-04,SMB\n"})
    land_csv(spark, folder, "customers", out, ckpt).awaitTermination()
    assert read() == WANT | {("C9", "2023-04-04", "SMB", "DE", "1")}


def test_replace_swap_and_restore(spark, tmp_path):
    a, b = VersionedTable(spark, str(tmp_path / "a")), VersionedTable(spark, str(tmp_path / "b"))
    assert a.current() is None and a.log().collect() == []
    with pytest.raises(ValueError, match="no version"):
        a.read()
    assert a.replace(spark.range(5)).count() == 5
    assert a.replace(spark.range(3).withColumn("p", F.col("id") % 2), ["p"]).count() == 3  # other columns, too
    b.replace(spark.range(7))
    assert a.swap(b).count() == 7
    assert a.restore(1).count() == 5
    assert [(r["seq"], r["row_count"], r["step"]) for r in a.log().orderBy("seq").collect()] == [(1, 5, "replace"), (2, 3, "replace"), (3, 7, "swap"), (4, 5, "restore")]
    assert a.replace(spark.range(0)).count() == 0
    with pytest.raises(ValueError, match="no such version"):
        a.restore(99)


def test_a_write_that_fails_half_way_changes_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(10))
    breaks = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        t.replace(breaks)
    assert len(os.listdir(tmp_path / "t" / "data")) == 2  # what the failed write left
    assert VersionedTable(spark, str(tmp_path / "t")).read().count() == 10
    assert t.replace(spark.range(2)).count() == 2 and t.current()["seq"] == 2


def test_files_that_lack_rows_are_not_committed(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(10))

    class Seen:
        get = {"row_count": 11}

    monkeypatch.setattr(sinks, "Observation", Seen)
    monkeypatch.setattr(type(spark.range(1)), "observe", lambda self, *a: self)
    with pytest.raises(sinks.IncompleteWrite, match="11 rows written, 4 in the files"):
        t.replace(spark.range(4))
    assert t.read().count() == 10


def test_of_two_writers_of_one_commit_one_is_told(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(1))
    late = VersionedTable(spark, str(tmp_path / "t"))
    monkeypatch.setattr(late, "current", lambda: None)  # it read the log before the first commit
    first = t.current()["location"]
    late_wins = False
    try:
        late.replace(spark.range(2))
        late_wins = True
    except sinks.TableConflict:
        pass
    now = t.current()
    assert now["seq"] == 1 and (now["location"] != first) == late_wins
    assert t.read().count() == (2 if late_wins else 1)


def test_a_load_that_loses_lines_says_so(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    row = sinks.load_csv(spark, drop(tmp_path / "in"), "customers", t).first()
    assert row.asDict() == {"table_name": "customers", "lines_read": 4, "rejected": 1, "rows_written": 3, "rows_in_table": 3, "difference": 1}
    clean = {k: v for k, v in TWO_ORDERS.items() if k == "b.csv"}
    assert sinks.load_csv(spark, drop(tmp_path / "in2", clean), "customers", t).first()["difference"] == 0
    assert {tuple(r) for r in t.read().collect()} == {x for x in WANT if x[0] == "C2"}


@pytest.mark.parametrize("name", ["csv_by_name", "load_reconciliation", "table_versions"])
def test_queries_against_sql(spark, name):
    import __spark_entry__ as E
    from oracle_check import canon, duck

    got, want = E.queries()[name](spark, SMALL).toPandas(), duck(SMALL).sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert canon(got) == canon(want)
    if name == "load_reconciliation":
        assert (got["difference"] > 0).all()
