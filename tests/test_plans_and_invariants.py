"""Plan shape (no nested-loop / cartesian joins, no Python UDFs) and result invariants."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from subsight.plans.workload import Workload

BAD_NODES = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")


@pytest.fixture(scope="module")
def w(spark):
    return Workload.from_testdata(spark, SMALL)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("product", ["core_metrics", "funnel_performance", "churn_base"])
def test_no_pairwise_joins_or_udfs(w, product):
    plan = _plan(getattr(w, product)())
    for node in BAD_NODES:
        assert node not in plan, node


def test_scan_is_pruned(spark):
    from subsight.sources.testdata import read_tables

    df = read_tables(spark, SMALL)["orders"].select("o_orderkey", "o_custkey").filter("o_orderkey > 5")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_metric_invariants(w):
    cm = w.core_metrics().cache()
    assert cm.filter(F.col("arr") != F.col("mrr") * 12).count() == 0
    assert cm.groupBy("month_start", "segment", "country", "source").count().filter("count > 1").count() == 0
    # cells partition the active (customer, cell) pairs of each month: a customer listed in two segments is in both
    per_month = cm.groupBy("month_start").agg(F.sum("active_customers").alias("n"))
    from subsight.operators import metrics as M

    distinct = M.active_customers_by_month(w.customer_segments(), w.dim).groupBy("month_start").agg(
        F.count_distinct("customer_id", "segment", "country", "source").alias("n")
    )
    assert per_month.exceptAll(distinct).count() == 0 and distinct.exceptAll(per_month).count() == 0
    cm.unpersist()


def test_funnel_invariants(w):
    fp = w.funnel_performance().cache()
    people = w.customers.select("customer_id", "segment", "country", F.trunc("signup_date", "MM")).distinct()
    assert fp.agg(F.sum("total_signups")).first()[0] == people.count()
    pairs = [("signup_to_trial_pct", "signup_dropoff_pct", "total_signups"),
             ("trial_to_activated_pct", "trial_dropoff_pct", "total_trials"),
             ("activated_to_paid_pct", "activated_dropoff_pct", "total_activated")]
    for pct, drop, den in pairs:
        assert fp.filter((F.col(pct) < 0) | (F.col(pct) > 100)).count() == 0
        assert fp.filter((F.col(den) > 0) & (F.col(pct) + F.col(drop) != 100)).count() == 0
        assert fp.filter((F.col(den) == 0) & ((F.col(pct) != 0) | (F.col(drop) != 0))).count() == 0
    fp.unpersist()


def test_paid_equals_active_customers_somewhere(w):
    """Both products count a paying customer the same way: any active subscription."""
    fp_paid = w.funnel_performance().agg(F.sum("total_paid")).first()[0]
    payers = w.subscriptions.filter("status = 'active' AND start_date IS NOT NULL").select("customer_id").distinct()
    people = w.customers.select("customer_id", "segment", "country", F.trunc("signup_date", "MM")).distinct()
    assert fp_paid == people.join(payers, "customer_id", "left_semi").count()


def test_fast_summary_equals_counting_every_check(w):
    import datetime as dt

    from subsight.operators import quality as Q

    as_of = dt.date(2000, 6, 30)
    fast = {r.check_name: r.rows for r in Q.workload_summary(w, as_of).collect()}
    slow = {r.check_name: r.rows for r in Q.summary(Q.all_checks(w, as_of)).collect()}
    assert fast == slow and len(fast) == len(Q.CHECKS)
