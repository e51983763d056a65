"""Sinks (replace-mode tables, check folder + summary) and the incremental CSV landing."""

import os
import tempfile

from subsight.operators import quality as Q
from subsight.sources import sinks
from subsight.streaming.ingest import land_csv


def test_write_table_replaces(spark):
    d = tempfile.mkdtemp(prefix="subsight-sink-")
    p = os.path.join(d, "t")
    a = sinks.write_table(spark.range(5).toDF("x"), p)
    assert a.count() == 5
    b = sinks.write_table(spark.range(3).toDF("x"), p)
    assert b.count() == 3


def test_write_checks_with_summary(spark):
    d = tempfile.mkdtemp(prefix="subsight-checks-")
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "customer_id string")
    checks = {"dups": Q.duplicate_key_counts(df), "none": df.filter("false")}
    summary = {r.check_name: r.rows for r in sinks.write_checks(checks, d).collect()}
    assert summary == {"dups": 1, "none": 0}
    assert os.path.isdir(os.path.join(d, "none"))


def test_preview_is_ordered(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",)], "customer_id string")
    assert [r.customer_id for r in sinks.preview(df, "customer_id", 2).collect()] == ["a", "b"]


def test_csv_landing_is_incremental(spark):
    root = tempfile.mkdtemp(prefix="subsight-land-")
    landing, out, ckpt = (os.path.join(root, x) for x in ("in", "out", "ckpt"))
    os.makedirs(landing)
    header = "event_id,customer_id,event_type,event_date,source\n"
    with open(os.path.join(landing, "a.csv"), "w") as f:
        f.write(header + "E1,C1,signup,2023-01-01,ads\nE2,C1,trial_start,,NA\n")
    land_csv(spark, landing, "events", out, ckpt).awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == 2
    # empty field -> NULL, the text NA stays text
    r = first.filter("event_id = 'E2'").first()
    assert r.event_date is None and r.source == "NA"
    with open(os.path.join(landing, "b.csv"), "w") as f:
        f.write(header + "E3,C2,signup,2023-02-01,organic\n")
    land_csv(spark, landing, "events", out, ckpt).awaitTermination()
    assert sorted(x.event_id for x in spark.read.parquet(out).collect()) == ["E1", "E2", "E3"]


def test_stream_landing_feeds_the_workload(spark):
    from pyspark.sql import functions as F

    from conftest import SMALL
    from subsight.plans.workload import Workload
    from subsight.streaming.ingest import land_all

    root = tempfile.mkdtemp(prefix="subsight-drop-")
    src = Workload.from_testdata(spark, SMALL)
    for name, df in src.raw.items():
        df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(os.path.join(root, "landing", name))
    land_all(spark, os.path.join(root, "landing"), os.path.join(root, "staging"), os.path.join(root, "ckpt"))
    streamed = Workload.from_staging(spark, os.path.join(root, "staging")).funnel_performance()
    # same data as a batch read of the drops (blank CSV fields read back as NULL in both)
    batch = Workload(
        {t: df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in df.columns]) for t, df in src.raw.items()}
    ).funnel_performance()
    assert streamed.count() > 0
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
