"""Report roll-ups: levels of the cube agree, and churn is recomputed from sums."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SMALL
from subsight.operators import report as R
from subsight.plans.workload import Workload

D = dt.date


def test_cube_levels_sum_to_month_totals(spark):
    w = Workload.from_testdata(spark, SMALL)
    cube = R.metrics_cube(w.core_metrics()).cache()
    top = cube.filter("grouping_id = 7").select("month_start", F.col("mrr").alias("total"),
                                                F.col("active_customers").alias("n"))
    for gid in (0, 3, 5, 6):  # all keys, segment only, country only, source only
        lvl = cube.filter(f"grouping_id = {gid}").groupBy("month_start").agg(
            F.sum("mrr").alias("s"), F.sum("active_customers").alias("c")
        )
        diff = lvl.join(top, "month_start").filter((F.col("s") != F.col("total")) | (F.col("c") != F.col("n")))
        assert diff.count() == 0, gid
    cube.unpersist()


def test_overall_churn_is_not_a_mean_of_cell_rates(spark):
    rows = [
        (D(2023, 1, 1), "SMB", "UK", "ads", Decimal("100.00"), 10, 0, Decimal("0.00")),
        (D(2023, 1, 1), "ENT", "UK", "ads", Decimal("900.00"), 90, 0, Decimal("0.00")),
        (D(2023, 2, 1), "SMB", "UK", "ads", Decimal("50.00"), 5, 5, Decimal("50.00")),
        (D(2023, 2, 1), "ENT", "UK", "ads", Decimal("900.00"), 90, 0, Decimal("0.00")),
    ]
    cm = spark.createDataFrame(
        rows,
        "month_start date, segment string, country string, source string, mrr decimal(22,2), "
        "active_customers bigint, churned_logos bigint, lost_mrr decimal(22,2)",
    ).withColumn("arr", F.col("mrr") * 12)
    feb = R.churn_by(cm).filter(F.col("month_start") == D(2023, 2, 1)).first()
    # 5 churned of 100 active last month -> 5 %, although the cells' own rates are 50 % and 0 %
    assert feb.logo_churn_rate_pct == Decimal("5.00")
    assert feb.revenue_churn_rate_pct == Decimal("5.00")


def test_funnel_cells_unique(spark):
    fp = Workload.from_testdata(spark, SMALL).funnel_performance()
    keys = ["month_start", "segment", "country", "source"]
    assert fp.groupBy(*keys).count().filter("count > 1").count() == 0
