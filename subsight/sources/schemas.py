"""Declared schemas for every layer. Nothing is ever inferred.

Staging tables accept any text (all strings, like the loose landing tables of
the workload); the cleaned layer carries the real types.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

CUSTOMERS_STAGING = T.StructType(
    [T.StructField(c, S) for c in ("customer_id", "signup_date", "segment", "country", "is_enterprise")]
)
SUBSCRIPTIONS_STAGING = T.StructType(
    [
        T.StructField(c, S)
        for c in ("subscription_id", "customer_id", "start_date", "end_date", "monthly_price", "status")
    ]
)
EVENTS_STAGING = T.StructType(
    [T.StructField(c, S) for c in ("event_id", "customer_id", "event_type", "event_date", "source")]
)

STAGING = {
    "customers": CUSTOMERS_STAGING,
    "subscriptions": SUBSCRIPTIONS_STAGING,
    "events": EVENTS_STAGING,
}

PRICE = T.DecimalType(10, 2)
# Money after aggregation; wide enough for sums over billions of rows.
MONEY = T.DecimalType(22, 2)
# Uncapped churn / revenue rates and ARPC-like ratios.
RATE = T.DecimalType(18, 2)
# Capped funnel percentages (0.00 .. 100.00).
PCT = T.DecimalType(5, 2)

CUSTOMERS_CLEAN = T.StructType(
    [
        T.StructField("customer_id", S),
        T.StructField("signup_date", T.DateType()),
        T.StructField("segment", S),
        T.StructField("country", S),
        T.StructField("is_enterprise", T.IntegerType()),
    ]
)
SUBSCRIPTIONS_CLEAN = T.StructType(
    [
        T.StructField("subscription_id", S),
        T.StructField("customer_id", S),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("monthly_price", PRICE),
        T.StructField("status", S),
    ]
)
EVENTS_CLEAN = T.StructType(
    [
        T.StructField("event_id", S),
        T.StructField("customer_id", S),
        T.StructField("event_type", S),
        T.StructField("event_date", T.DateType()),
        T.StructField("source", S),
    ]
)

# Declared width / nullability rules of the cleaned tables (checked by a report
# job rather than enforced by a store): column -> (max length or None, nullable).
COLUMN_RULES = {
    "customers": {
        "customer_id": (20, False),
        "signup_date": (None, True),
        "segment": (20, True),
        "country": (2, True),
        "is_enterprise": (None, False),
    },
    "subscriptions": {
        "subscription_id": (20, False),
        "customer_id": (20, True),
        "start_date": (None, False),
        "end_date": (None, True),
        "monthly_price": (None, False),
        "status": (10, False),
    },
    "events": {
        "event_id": (20, False),
        "customer_id": (20, True),
        "event_type": (50, True),
        "event_date": (None, False),
        "source": (50, True),
    },
}

KEYS = {"customers": "customer_id", "subscriptions": "subscription_id", "events": "event_id"}
