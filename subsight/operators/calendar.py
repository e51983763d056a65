"""The month axis (M1-M2) and the "active at month end" expansion.

The spine bounds are one small aggregate; callers pass the two dates on as scalar subqueries, which
Spark runs once for a query, as part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import month_start

def _one_month():
    return F.expr("INTERVAL 1 MONTH")


def spine_bounds(customers: DataFrame, subs: DataFrame, events: DataFrame) -> DataFrame:
    """``(lo, hi)``: the first and the last month of the calendar, as one row (nulls without any date).

    First = month of the earliest signup; last = month of the latest date seen
    anywhere (end, start, event and signup dates). One aggregate over a union of
    the date columns (``greatest`` and ``max`` skip NULLs, as MAX over a UNION ALL
    does). Subscriptions and events may be passed *before* deduplication: the
    extremes of a column do not change when duplicate rows collapse.
    """
    none = F.lit(None).cast("date").alias("lo_d")
    d = (
        customers.select(F.col("signup_date").alias("lo_d"), F.col("signup_date").alias("hi_d"))
        .unionByName(subs.select(none, F.greatest("end_date", "start_date").alias("hi_d")))
        .unionByName(events.select(none, F.col("event_date").alias("hi_d")))
    )
    return d.agg(month_start(F.min("lo_d")).alias("lo"), month_start(F.max("hi_d")).alias("hi"))


def month_spine(bounds: DataFrame) -> DataFrame:
    """M1+M2: one row per month from the first to the last month, with its last day.

    Generated by ``sequence`` from the one-row ``bounds`` (never a recursive CTE:
    Spark caps recursion depth at 100 levels).
    """
    return bounds.select(F.explode(F.sequence("lo", "hi", _one_month())).alias("month_start")).select(
        "month_start", F.last_day("month_start").alias("month_end")
    )


def active_spans(subs: DataFrame, lo: Column, hi: Column, status: str = "active") -> DataFrame:
    """Each subscription's run of active months as one row: (..., _f, _l), first and last
    spine month at whose last day it is active; subscriptions never active are dropped.

    Active at month M means ``start <= last_day(M)`` and (``end`` is NULL or
    ``end > last_day(M)``), i.e. ``trunc(start) <= M <= trunc(end) - 1 month``.
    """
    start_m = month_start("start_date")
    first = F.greatest(start_m, lo)
    last = F.when(F.col("end_date").isNull(), hi).otherwise(
        F.least(hi, F.add_months(month_start("end_date"), -1))
    )
    s = subs.filter((F.col("status") == status) & F.col("start_date").isNotNull())
    s = s.select("subscription_id", "customer_id", "monthly_price", first.alias("_f"), last.alias("_l"))
    return s.filter(F.col("_f") <= F.col("_l"))


def active_subscription_months(
    subs: DataFrame, lo: Column, hi: Column, status: str = "active"
) -> DataFrame:
    """(subscription, month) for every spine month at whose last day the subscription is active.

    Active at month M means ``start <= last_day(M)`` and (``end`` is NULL or
    ``end > last_day(M)``). Both sides reduce to month arithmetic:
    ``trunc(start) <= M`` and ``M <= trunc(end) - 1 month``. So each subscription
    expands to a contiguous run of months clipped to the spine: a per-row
    generator, with no join and no shuffle, instead of months x subscriptions.
    """
    s = active_spans(subs, lo, hi, status)
    return s.select(
        F.explode(F.sequence("_f", "_l", _one_month())).alias("month_start"),
        "subscription_id",
        "customer_id",
        "monthly_price",
    )
