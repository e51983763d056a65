"""The end-to-end batch job, from driver tables and from a CSV drop folder."""

import os
import tempfile

from conftest import SMALL
from subsight.plans import jobs
from subsight.plans.workload import Workload


def test_job_writes_everything_and_matches_lazy_products(spark):
    out = tempfile.mkdtemp(prefix="subsight-job-")
    w = Workload.from_testdata(spark, SMALL)
    paths = jobs.run(spark, w, out)
    cm = spark.read.parquet(os.path.join(out, "core_saas_metrics_detailed"))
    lazy = Workload.from_testdata(spark, SMALL).core_metrics()
    assert cm.select(*lazy.columns).exceptAll(lazy).count() == 0
    assert lazy.exceptAll(cm.select(*lazy.columns)).count() == 0
    summary = spark.read.parquet(os.path.join(paths["checks"], "check_summary"))
    assert summary.count() == len(os.listdir(paths["checks"])) - 1
    assert os.path.isdir(os.path.join(paths["reports"], "report_funnel_stages"))


def test_csv_drop_gives_same_products(spark):
    src = Workload.from_testdata(spark, SMALL)
    folder = tempfile.mkdtemp(prefix="subsight-csv-")
    for name, df in src.raw.items():
        tmp = os.path.join(folder, name + "_parts")
        df.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(tmp)
        part = [f for f in os.listdir(tmp) if f.startswith("part-")][0]
        os.link(os.path.join(tmp, part), os.path.join(folder, f"{name}.csv"))
    # A blank CSV field reads back as NULL (not ''), so compare with the same data
    # where every empty string is NULL.
    from pyspark.sql import functions as F

    blank_null = Workload(
        {t: df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in df.columns]) for t, df in src.raw.items()}
    )
    from_csv = Workload.from_csv(spark, folder).funnel_performance()
    direct = blank_null.funnel_performance()
    assert from_csv.exceptAll(direct).count() == 0 and direct.exceptAll(from_csv).count() == 0
