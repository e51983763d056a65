"""Cleaning, typing, deduplication and the signup override.

Every step is a single projection or a single hash aggregate; nothing here
materialises, so the whole chain fuses into the scans that feed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Fixed values of the workload: the event and status vocabulary.
SIGNUP, TRIAL, ACTIVATED, CHURNED = "signup", "trial_start", "activated", "churned"
ACTIVE, CANCELED = "active", "canceled"


def clean_customers(raw: DataFrame) -> DataFrame:
    """Parse the signup date, blank segment -> 'Unknown', trim country, flag text -> 0/1."""
    return raw.select(
        "customer_id",
        S.parse_date("signup_date").alias("signup_date"),
        S.fill_default("segment").alias("segment"),
        F.trim("country").alias("country"),
        S.parse_flag("is_enterprise").alias("is_enterprise"),
    )


def clean_subscriptions(raw: DataFrame) -> DataFrame:
    """Parse both dates, money text -> decimal(10,2), trim status."""
    return raw.select(
        "subscription_id",
        "customer_id",
        S.parse_date("start_date").alias("start_date"),
        S.parse_date("end_date").alias("end_date"),
        S.parse_money("monthly_price").alias("monthly_price"),
        F.trim("status").alias("status"),
    )


def clean_events(raw: DataFrame) -> DataFrame:
    """Trim type and source, parse the date."""
    return raw.select(
        "event_id",
        "customer_id",
        F.trim("event_type").alias("event_type"),
        S.parse_date("event_date").alias("event_date"),
        F.trim("source").alias("source"),
    )


def with_collation(df: DataFrame, collation: str | None) -> DataFrame:
    """Give every text column ``collation`` (e.g. 'UNICODE_CI_AI': case- and
    accent-insensitive), so all later comparisons, groupings and joins use it.
    ``None`` keeps exact (binary) matching, the default."""
    if not collation:
        return df
    return df.select(
        *[
            F.collate(F.col(f.name), collation).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


EVENT_DEDUP_KEYS = ["customer_id", "event_type", "event_date", "source"]
SUB_DEDUP_KEYS = ["customer_id", "start_date", "end_date", "monthly_price", "status"]


def dedup_events(events: DataFrame) -> DataFrame:
    """C11: one row per (customer, type, date, source), keeping the smallest event_id.

    A plain hash aggregate: the partial (map-side) step collapses copies before
    the shuffle, so a customer with millions of repeated events ships one row per
    distinct key from each task. NULL keys group together, as in SQL.
    """
    return events.groupBy(*EVENT_DEDUP_KEYS).agg(F.min("event_id").alias("event_id")).select(
        "event_id", *EVENT_DEDUP_KEYS
    )


def dedup_subscriptions(subs: DataFrame) -> DataFrame:
    """One row per (customer, start, end, price, status), keeping the smallest id."""
    return subs.groupBy(*SUB_DEDUP_KEYS).agg(F.min("subscription_id").alias("subscription_id")).select(
        "subscription_id", *SUB_DEDUP_KEYS
    )


def customer_event_profile(events: DataFrame) -> DataFrame:
    """Everything the products need from the event log, per customer, in one aggregate.

    * ``event_signup_date``: first signup date (drives the signup override, C13);
    * ``signup_source``: largest source among signup events (the acquisition
      channel, J5), NULL when there is none;
    * ``has_trial_start`` / ``has_activated`` / ``has_churned``: a dated event of that
      type exists (the funnel stages, N1).
    """
    t, d = F.col("event_type"), F.col("event_date")

    def has(kind: str):
        return F.max(F.when((t == kind) & d.isNotNull(), F.lit(1)).otherwise(F.lit(0))).alias(f"has_{kind}")

    return events.groupBy("customer_id").agg(
        F.min(F.when(t == SIGNUP, d)).alias("event_signup_date"),
        F.max(F.when(t == SIGNUP, F.col("source"))).alias("signup_source"),
        has(TRIAL),
        has(ACTIVATED),
        has(CHURNED),
    )


CUSTOMER_COLS = ["customer_id", "signup_date", "segment", "country", "is_enterprise"]


def customer_dimension(customers: DataFrame, profile: DataFrame) -> DataFrame:
    """C13 + J5: the customer table with the signup override and everything per customer.

    One left join of customers to the per-customer event aggregate gives
    signup_date := first signup event date (else the customer's own), the
    acquisition channel ('Unknown' without a signup event) and the funnel flags.
    The workload declares customer_id the key of this table (``check_primary_keys``
    reports violations), so downstream joins are many-to-one.
    """
    j = customers.join(profile, "customer_id", "left")
    return j.select(
        "customer_id",
        F.coalesce("event_signup_date", "signup_date").alias("signup_date"),
        "segment",
        "country",
        "is_enterprise",
        F.coalesce("signup_source", F.lit("Unknown")).alias("source"),
        "has_trial_start",
        "has_activated",
        "has_churned",
    )

