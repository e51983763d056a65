"""Quantiles of any distribution, hot keys in joins and duplicates, and ranks, without one task that holds them."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsight.operators import quality as Q
from subsight.operators import quantile
from subsight.operators.expand import expand_counts
from subsight.operators.ordering import with_rank
from subsight.operators.skew import hot_keys, salted_join

PROBS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
rng = random.Random(7)
COLUMNS = {
    "outlier": [1e300, *[float(k) for k in range(999)]],
    "crowded": [1e15 + k / 8 for k in range(500)] + [-1e-300, 0.0, -0.0, 5e-324],
    "negative": [-abs(rng.gauss(0, 10) ** 9) for _ in range(301)],
    "mixed": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
    "hot": [3.0] * 900 + [2.0] * 50 + [4.0] * 51,
    "two": [1.0, 2.0],
    "one": [7.25],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_quantiles_of_any_distribution(spark, name):
    values = COLUMNS[name]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(4)
    got = {r["prob"]: r["quantile"] for r in quantile.exact_quantiles(df, F.col("x"), PROBS).collect()}
    ordered = sorted(values)
    for p in PROBS:
        h = (len(ordered) - 1) * p
        low = int(h)
        want = ordered[low] if h == low else ordered[low] + (h - low) * (ordered[low + 1] - ordered[low])
        assert got[p] == pytest.approx(want, rel=1e-12), (name, p)
    assert got[0.5] == pytest.approx(statistics.median(values))


def test_no_round_orders_more_than_its_digits(spark, monkeypatch):
    """A third of a million distinct values between outliers: each round leaves at most 2 ** DIGIT rows for a rank."""
    monkeypatch.setattr(quantile, "DIGIT", 8)
    n = 300_000
    df = spark.range(n).select(F.when(F.col("id") == 0, 1e300).when(F.col("id") == 1, -1e300).otherwise(F.col("id") / 3).alias("x"))
    counted = quantile.value_counts_of(df, F.col("x"))
    asked = spark.createDataFrame([(0.5, 0, 0.0, 0, n // 2)], "prob double, i int, frac double, prefix long, rank long")
    for shift in range(56, -1, -8):
        own = counted if shift == 56 else counted.join(asked, F.shiftright("k", shift + 8) == F.col("prefix"))
        assert own.select(F.shiftright("k", shift)).distinct().count() <= 256
        asked = quantile.narrowed(counted, asked.drop("v"), shift)
        assert asked.count() == 1
    assert asked.first()["v"] == pytest.approx((n // 2 + 1) / 3)  # below it: the negative outlier and the ids from 2 on


def test_bits_order_as_doubles(spark):
    values = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0000000000000002, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["v"] for r in df.orderBy(quantile.ordered_bits(F.col("v"))).collect()] == values


def test_describe_reads_its_table_twice(spark):
    from conftest import SMALL
    from subsight.operators import profile as P
    from subsight.plans.workload import Workload

    w = Workload.from_testdata(spark, SMALL)
    plan = P.describe_numeric(w.typed("subscriptions"), "monthly_price")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_") <= 1  # the other read wrote the value counts


@pytest.fixture
def no_replanning(spark):
    """At run time no skewed partition is split, no small ones are put together, no small side is broadcast."""
    off = {"spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    names, before = list(off), [spark.conf.get(n) for n in off]
    for n, value in off.items():
        spark.conf.set(n, value)
    yield
    for n, value in zip(names, before):
        spark.conf.set(n, value)


def hot_tables(spark, n=30_000):
    events = [("hot" if k % 3 else None if k % 5 == 0 else f"c{k % 400}", "signup" if k % 2 else "churned", f"2023-{1 + k % 12:02d}-01" if k % 7 else None, k) for k in range(n)]
    customers = [(f"c{k}", "2023-06-01" if k % 4 else None) for k in range(450)] + [("hot", "2023-06-01"), ("hot", "2023-03-01"), (None, "2023-05-01")]
    e = spark.createDataFrame(events, "customer_id string, event_type string, event_date string, event_id int").withColumn("event_date", F.to_date("event_date"))
    c = spark.createDataFrame(customers, "customer_id string, signup_date string").withColumn("signup_date", F.to_date("signup_date"))
    return e, c


def test_a_hot_customer_is_dealt_over_tasks(spark, no_replanning):
    events, customers = hot_tables(spark)
    hot = {r["_hot"]: r["_salts"] for r in hot_keys(events, "customer_id", 1000).collect()}
    assert hot == {"hot": 20, None: 2}
    kept = customers.select(F.col("customer_id").alias("k"), "signup_date")
    met = salted_join(events, kept, "customer_id", "k", 1000)
    per_task = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    plain = events.join(kept, events["customer_id"].eqNullSafe(kept["k"]))
    assert sum(per_task) == plain.count() and max(per_task) < sum(per_task) / 3
    assert met.exceptAll(plain.select(met.columns)).count() == 0


def test_checks_with_a_hot_customer(spark, no_replanning):
    events, customers = hot_tables(spark, 6000)
    pdf_e, pdf_c = events.toPandas(), customers.toPandas()
    by = {}
    for c, d in pdf_c.itertuples(index=False):
        by.setdefault(c, []).append(d)
    early = sum(d < s for c, _, d, _ in pdf_e.itertuples(index=False) if d is not None for s in by.get(c, []) if s is not None)
    assert Q.events_before_signup(events, customers, 500).count() == early > 0
    signups = {}
    for c, t, d, _ in pdf_e.itertuples(index=False):
        if t == "signup":
            signups.setdefault(c, []).append(d)
    differ = sum(sum(d != s for d in signups[c]) if c in signups else 1 for c, days in by.items() for s in days if s is not None)
    assert Q.signup_mismatch(customers, events, 500).count() == differ > 0


def test_a_hundred_million_copies_from_many_tasks(spark):
    n = 100_000_000
    df = spark.createDataFrame([("x", n), ("y", 1), ("z", 8193), ("gone", 0)], "a string, n long")
    out = expand_counts(df, "n")
    held = out.groupBy("a", F.spark_partition_id().alias("p")).count().collect()
    total = {}
    for r in held:
        total[r["a"]] = total.get(r["a"], 0) + r["count"]
    assert total == {"x": n, "y": 1, "z": 8193}
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in held) < 2 * n / width


def test_small_chunks_go_through_all_levels(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1234), (None, 64), (None, 65)], "a string, n long")
    got = {r["a"]: r["count"] for r in expand_counts(df, "n", chunk=4).groupBy("a").count().collect()}
    assert got == {"x": 1235, None: 129}


def test_ranks_are_the_places_in_the_whole_order(spark):
    values = [(k * 7919 % 5000, None if k % 10 == 0 else f"v{k % 3}") for k in range(5000)]
    df = spark.createDataFrame(values, "a int, b string").repartition(7)
    got = with_rank(df, F.asc("b"), F.desc("a")).collect()
    want = sorted(values, key=lambda r: (r[1] is not None, r[1] or "", -r[0]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
    assert with_rank(df.filter("false"), F.asc("a")).collect() == []


def test_numpy_agrees_on_quartiles(spark):
    values = np.random.default_rng(3).lognormal(0, 20, 4001)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r["prob"]: r["quantile"] for r in quantile.exact_quantiles(df, F.col("x"), (0.25, 0.5, 0.75)).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p), rel=1e-12)
