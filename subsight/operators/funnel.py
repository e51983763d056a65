"""Signup-cohort funnel by cell.

Stages are independent flags per customer (not a strict sequence): trial and
activated mean a dated event of that type exists, paid means any active
subscription, churned means a dated churned event *and* paid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .cleaning import ACTIVE

CELL = ["month_start", "segment", "country", "source"]
TOTALS = ["total_signups", "total_trials", "total_activated", "total_paid", "total_churned"]
RATES = [
    "signup_to_trial_pct",
    "signup_dropoff_pct",
    "trial_to_activated_pct",
    "trial_dropoff_pct",
    "activated_to_paid_pct",
    "activated_dropoff_pct",
    "paid_to_churn_pct",
    "paid_retention_pct",
]


def paying_customers(subs: DataFrame) -> DataFrame:
    """Customers with at least one active subscription (one row each)."""
    return (
        subs.filter((F.col("status") == ACTIVE) & F.col("start_date").isNotNull())
        .select("customer_id")
        .distinct()
        .withColumn("paid", F.lit(1))
    )


def customer_funnel_base(dim: DataFrame, subs: DataFrame) -> DataFrame:
    """One row per customer: signup month, cell keys, and the five stage flags.

    ``dim`` already carries the event-derived flags (one aggregate of the event
    log per customer), so only the paying set is joined here. NULL segment or
    country become 'Unknown' in the funnel (the metric table keeps them). Rows that
    agree in month, customer, segment and country are one.
    """
    j = dim.join(paying_customers(subs), "customer_id", "left")
    return j.select(
        S.month_start("signup_date").alias("month_start"),
        "customer_id",
        F.coalesce("segment", F.lit("Unknown")).alias("segment"),
        F.coalesce("country", F.lit("Unknown")).alias("country"),
        "source",
        F.lit(1).alias("signup"),
        F.coalesce("has_trial_start", F.lit(0)).alias("trial"),
        F.coalesce("has_activated", F.lit(0)).alias("activated"),
        F.coalesce("paid", F.lit(0)).alias("paid"),
        F.coalesce("has_churned", F.lit(0)).alias("churned"),
    ).distinct()


def funnel_counts(base: DataFrame) -> DataFrame:
    """Stage totals per cell; churn counts only customers who also paid."""
    return base.groupBy(*CELL).agg(
        F.sum("signup").cast("bigint").alias("total_signups"),
        F.sum("trial").cast("bigint").alias("total_trials"),
        F.sum("activated").cast("bigint").alias("total_activated"),
        F.sum("paid").cast("bigint").alias("total_paid"),
        F.sum(F.when((F.col("paid") == 1) & (F.col("churned") == 1), 1).otherwise(0))
        .cast("bigint")
        .alias("total_churned"),
    )


def funnel_rates(counts: DataFrame) -> DataFrame:
    """The eight percentages (capped conversion, drop-off, floored retention)."""
    s, t, a, p, c = (F.col(x) for x in TOTALS)
    return counts.select(
        "*",
        S.capped_pct(t, s).alias("signup_to_trial_pct"),
        S.dropoff_pct(t, s).alias("signup_dropoff_pct"),
        S.capped_pct(a, t).alias("trial_to_activated_pct"),
        S.dropoff_pct(a, t).alias("trial_dropoff_pct"),
        S.capped_pct(p, a).alias("activated_to_paid_pct"),
        S.dropoff_pct(p, a).alias("activated_dropoff_pct"),
        S.capped_pct(c, p).alias("paid_to_churn_pct"),
        S.retention_pct(c, p).alias("paid_retention_pct"),
    )


def funnel_flags(counts: DataFrame) -> DataFrame:
    """The anomaly flag of each row."""
    s, t, a, p, c = (F.col(x) for x in TOTALS)
    return counts.withColumn("data_flag", S.funnel_flag(s, t, a, p, c))


def rates_and_flags(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """N3 + N4 on any frame of the five totals (also used by the report roll-ups)."""
    keys = CELL if keys is None else keys
    return funnel_flags(funnel_rates(counts)).select(*keys, *TOTALS, *RATES, "data_flag")


def funnel_performance(dim: DataFrame, subs: DataFrame) -> DataFrame:
    """The funnel table, ordered by month, segment, country, source."""
    return rates_and_flags(funnel_counts(customer_funnel_base(dim, subs))).orderBy(*CELL)
