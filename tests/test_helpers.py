"""Distributed helpers: exact quantiles and copy expansion."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from subsight.operators.expand import expand_counts
from subsight.operators.quantile import exact_quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def _check(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r.prob: r.quantile for r in exact_quantiles(df, F.col("x"), PROBS).collect()}
    for p in PROBS:
        assert abs(got[p] - float(np.percentile(values, p * 100))) < 1e-9, (p, got[p])


def test_quantiles_hot_value(spark):
    values = [5.0] * 400 + list(range(100)) + [1e6]
    _check(spark, values)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    _check(spark, values)


def test_expand_counts_exact_copies(spark):
    df = spark.createDataFrame([("a", 1, 20001), ("b", None, 3), ("c", 2, 1)], "k string, v int, n long")
    out = expand_counts(df, "n", chunk=1000)
    assert out.columns == ["k", "v"]
    got = {(r.k, r.v): r.c for r in out.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert got == {("a", 1): 20001, ("b", None): 3, ("c", 2): 1}
    assert out.rdd.getNumPartitions() > 1


def test_describe_approx_option_close_to_exact(spark):
    from subsight.operators.profile import describe_numeric

    df = spark.range(0, 20001).selectExpr("cast(id as decimal(10,2)) as p")
    exact = {r.statistic: r.value for r in describe_numeric(df, "p").collect()}
    approx = {r.statistic: r.value for r in describe_numeric(df, "p", approx_accuracy=10000).collect()}
    assert exact["50%"] == 10000.0 and exact["25%"] == 5000.0
    for k in ("25%", "50%", "75%"):
        assert abs(approx[k] - exact[k]) <= 20001 / 10000 + 1


def test_unique_approx_option(spark):
    from subsight.operators.quality import customers_unique

    df = spark.range(0, 5000).selectExpr("cast(id % 1000 as string) as customer_id")
    assert customers_unique(df).first().unique_count == 1000
    assert abs(customers_unique(df, approx_rsd=0.02).first().unique_count - 1000) < 60
