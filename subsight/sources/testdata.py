"""Derive the three raw landing tables (customers, subscriptions, events) from the
driver's TPC-H-style parquet tables.

The driver ships no subscription data, so the staging trio is computed from
``customer/nation/region``, ``orders`` and ``events`` with deterministic rules,
and deliberately dirtied (blank and padded fields, unparsable values, duplicate
rows, orphans, active subscriptions with an end date) so every cleaning step and
every data check has work to do. The same rules are written a second time as SQL
text (``*_SQL`` below) for the DuckDB oracle; the two must stay in step.

All rules are row-local expressions or a single aggregate, so the derivation
scales with the input like any other scan.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("customer", "nation", "region", "orders", "events")

# Fixed vocabulary of the mapping: driver event types -> workload event types,
# and the four acquisition channels, picked by event_id modulo 4.
EVENT_TYPE_MAP = {"view": "trial_start", "click": "activated", "error": "churned"}
SOURCES = ("ads", "organic", "outbound", "referral")


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in TABLES}


def _variants(*kinds: tuple[Column | None, Column]) -> Column:
    """One row for each kind whose condition holds (None: always), from a single scan."""
    return F.explode(F.filter(F.array(*[row if when is None else F.when(when, row) for when, row in kinds]), lambda r: r.isNotNull()))


def _ymd(c: Column) -> Column:
    # A date cast to text is ISO yyyy-MM-dd (years 1000-9999), without a formatter.
    return F.to_date(c).cast("string")


def raw_customers(customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame) -> DataFrame:
    # TPC-H fixes nation at 25 rows and region at 5: a proven size bound, so
    # both are broadcast and the customer scan is never shuffled for them.
    geo = F.broadcast(
        nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left").select(
            "n_nationkey", "r_name"
        )
    )
    first_order = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment").join(
        geo, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    c = c.join(first_order, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    code = F.substring("r_name", 1, 2)
    is_auto = seg == F.lit("AUTOMOBILE")
    first = F.to_date("first_order")
    base = c.select(
        k.alias("k"),
        k.cast("string").alias("customer_id"),
        F.when(k % 28 == 0, F.lit(""))
        .when(k % 97 == 13, F.lit("2023-13-45"))
        .when((k % 37 == 2) & first.isNotNull(), F.concat_ws("-", F.year(first), F.month(first), F.day(first)))
        .when((k % 41 == 6) & first.isNotNull(), F.concat(_ymd(first), F.lit(" 00:00:00")))
        .otherwise(F.coalesce(_ymd(F.col("first_order")), F.lit("")))
        .alias("signup_date"),
        F.when(seg == F.lit("MACHINERY"), F.lit(""))
        .when(k % 10 == 3, F.concat(F.lit("  "), seg, F.lit(" ")))
        .otherwise(seg)
        .alias("segment"),
        F.when(k % 61 == 7, F.lit(""))
        .when(k % 89 == 11, F.col("r_name"))
        .when(k % 10 == 7, F.concat(F.lit(" "), code))
        .otherwise(code)
        .alias("country"),
        F.when(k % 101 == 9, F.lit("yes"))
        .when(k % 17 == 4, F.when(is_auto, F.lit(" t ")).otherwise(F.lit("0")))
        .when(is_auto, F.lit("True"))
        .otherwise(F.lit("False"))
        .alias("is_enterprise"),
    )
    names = ["customer_id", "signup_date", "segment", "country", "is_enterprise"]

    def row(**changed: Column) -> Column:
        return F.struct(*[changed.get(n, F.col(n)).alias(n) for n in names])

    b = F.col("k")
    kinds = _variants(
        (None, row()),
        (b % 31 == 5, row()),  # the same row again
        (b % 43 == 9, row(segment=F.lit("HOUSEHOLD"))),  # the same customer in another segment
        (b % 47 == 3, row(customer_id=F.concat(F.lit("N"), "customer_id"))),  # nobody subscribed or did anything
    )
    return base.select(kinds.alias("r")).select("r.*")


def raw_subscriptions(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    start = F.to_date("o_orderdate")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    status = F.when(st == "O", F.lit("active")).when(st == "F", F.lit("canceled")).otherwise(F.lit("trialing"))
    base = orders.select(
        k.alias("k"),
        k.cast("string").alias("subscription_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        _ymd(start).alias("start_date"),
        F.when(
            st == "F",
            F.when(k % 89 == 0, _ymd(F.date_sub(start, (k % 30 + 1).cast("int"))))
            .when(k % 73 == 0, F.lit(""))
            .otherwise(_ymd(F.date_add(start, (k % 400 + 1).cast("int")))),
        )
        .otherwise(F.lit(""))
        .alias("end_date"),
        F.when((st == "P") & (k % 41 == 0), F.concat(F.lit("-"), price))
        .when(k % 211 == 5, F.lit("n/a"))
        .when((st == "O") & (k % 157 == 3), F.lit("0.00"))
        .otherwise(price)
        .alias("monthly_price"),
        F.when(k % 19 == 0, F.concat(F.lit(" "), status, F.lit(" "))).otherwise(status).alias("status"),
        price.alias("clean_price"),
    )
    cols = ["subscription_id", "customer_id", "start_date", "end_date", "monthly_price", "status"]

    def row(**changed: Column) -> Column:
        return F.struct(*[changed.get(n, F.col(n)).alias(n) for n in cols])

    bk = F.col("k")
    kinds = _variants(
        (None, row()),
        (bk % 313 == 0, row()),  # exact copies
        (bk % 27 == 0, row(subscription_id=F.concat(F.lit("D"), "subscription_id"))),  # copies under new ids
        (
            bk % 50 == 1,  # active with an end date
            row(
                subscription_id=F.concat(F.lit("A"), "subscription_id"),
                end_date=_ymd(F.date_add(F.to_date("start_date"), (bk % 900).cast("int"))),
                monthly_price=F.col("clean_price"),
                status=F.lit("active"),
            ),
        ),
        (bk % 50 == 2, row(subscription_id=F.concat(F.lit("X"), "subscription_id"), customer_id=F.concat(F.lit("X"), "customer_id"))),  # orphans
    )
    return base.select(kinds.alias("r")).select("r.*")


def raw_events(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    cid = (F.col("user_id") * 10 + k % 10).cast("string")
    et = F.col("event_type")
    mapped = et
    for src, dst in EVENT_TYPE_MAP.items():
        mapped = F.when(et == src, F.lit(dst)).otherwise(mapped)
    src = F.when(i % 4 == 0, F.lit(SOURCES[0]))
    for n, name in enumerate(SOURCES[1:], start=1):
        src = src.when(i % 4 == n, F.lit(name))
    base = events.select(
        i.alias("k"),
        i.cast("string").alias("event_id"),
        F.when(i % 211 == 17, F.concat(F.lit("X"), cid)).otherwise(cid).alias("customer_id"),
        F.when(i % 13 == 0, F.concat(F.lit(" "), mapped, F.lit(" "))).otherwise(mapped).alias("event_type"),
        F.when(i % 997 == 0, F.lit(""))
        .otherwise(_ymd(F.add_months(F.to_date("ts"), -(F.lit(276) + i % 72).cast("int"))))
        .alias("event_date"),
        F.when(i % 11 == 0, F.concat(F.lit(" "), src)).otherwise(src).alias("source"),
    )
    cols = ["event_id", "customer_id", "event_type", "event_date", "source"]

    def row(**changed: Column) -> Column:
        return F.struct(*[changed.get(n, F.col(n)).alias(n) for n in cols])

    bk = F.col("k")
    kinds = _variants(
        (None, row()),
        (bk % 331 == 0, row()),  # exact copies
        (bk % 23 == 0, row(event_id=F.concat(F.lit("E"), "event_id"))),  # copies under new ids
    )
    return base.select(kinds.alias("r")).select("r.*")


def raw_trio(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three raw landing tables (all strings) for one scale-factor folder."""
    t = read_tables(spark, sf_dir)
    return {
        "customers": raw_customers(t["customer"], t["nation"], t["region"], t["orders"]),
        "subscriptions": raw_subscriptions(t["orders"]),
        "events": raw_events(t["events"]),
    }


# ---------------------------------------------------------------------------
# The same derivation as DuckDB SQL (views customer, nation, region, orders and
# events are registered by the oracle runner). Kept beside the Spark version on
# purpose: any change to one must be made to the other.
# ---------------------------------------------------------------------------

RAW_CUSTOMERS_SQL = """
cust_base AS (
  SELECT c.c_custkey AS k, CAST(c.c_custkey AS VARCHAR) AS customer_id,
         CASE WHEN c.c_custkey % 28 = 0 THEN ''
              WHEN c.c_custkey % 97 = 13 THEN '2023-13-45'
              WHEN c.c_custkey % 37 = 2 AND fo.first_order IS NOT NULL
                THEN concat_ws('-', year(fo.first_order), month(fo.first_order), day(fo.first_order))
              WHEN c.c_custkey % 41 = 6 AND fo.first_order IS NOT NULL THEN strftime(fo.first_order, '%Y-%m-%d 00:00:00')
              ELSE COALESCE(strftime(fo.first_order, '%Y-%m-%d'), '') END AS signup_date,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN ''
              WHEN c.c_custkey % 10 = 3 THEN concat('  ', c.c_mktsegment, ' ')
              ELSE c.c_mktsegment END AS segment,
         CASE WHEN c.c_custkey % 61 = 7 THEN ''
              WHEN c.c_custkey % 89 = 11 THEN r.r_name
              WHEN c.c_custkey % 10 = 7 THEN concat(' ', substr(r.r_name, 1, 2))
              ELSE substr(r.r_name, 1, 2) END AS country,
         CASE WHEN c.c_custkey % 101 = 9 THEN 'yes'
              WHEN c.c_custkey % 17 = 4 THEN CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN ' t ' ELSE '0' END
              WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'True'
              ELSE 'False' END AS is_enterprise
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) fo
         ON c.c_custkey = fo.o_custkey
),
raw_customers AS (
  SELECT * EXCLUDE (k) FROM cust_base
  UNION ALL SELECT * EXCLUDE (k) FROM cust_base WHERE k % 31 = 5
  UNION ALL SELECT customer_id, signup_date, 'HOUSEHOLD', country, is_enterprise FROM cust_base WHERE k % 43 = 9
  UNION ALL SELECT concat('N', customer_id), signup_date, segment, country, is_enterprise FROM cust_base WHERE k % 47 = 3
)"""

RAW_SUBSCRIPTIONS_SQL = """
sub_base AS (
  SELECT o_orderkey AS k,
         CAST(o_orderkey AS VARCHAR) AS subscription_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS start_date,
         CASE WHEN o_orderstatus = 'F' THEN
                CASE WHEN o_orderkey % 89 = 0
                       THEN strftime(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 + 1 AS INTEGER), '%Y-%m-%d')
                     WHEN o_orderkey % 73 = 0 THEN ''
                     ELSE strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 + 1 AS INTEGER), '%Y-%m-%d') END
              ELSE '' END AS end_date,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 41 = 0
                THEN concat('-', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR))
              WHEN o_orderkey % 211 = 5 THEN 'n/a'
              WHEN o_orderstatus = 'O' AND o_orderkey % 157 = 3 THEN '0.00'
              ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS monthly_price,
         CASE WHEN o_orderkey % 19 = 0 THEN concat(' ', st, ' ') ELSE st END AS status,
         CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS clean_price
  FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'canceled' ELSE 'trialing' END AS st
        FROM orders) o
),
raw_subscriptions AS (
  SELECT subscription_id, customer_id, start_date, end_date, monthly_price, status FROM sub_base
  UNION ALL
  SELECT subscription_id, customer_id, start_date, end_date, monthly_price, status FROM sub_base WHERE k % 313 = 0
  UNION ALL
  SELECT concat('D', subscription_id), customer_id, start_date, end_date, monthly_price, status
  FROM sub_base WHERE k % 27 = 0
  UNION ALL
  SELECT concat('A', subscription_id), customer_id, start_date,
         strftime(CAST(start_date AS DATE) + CAST(k % 900 AS INTEGER), '%Y-%m-%d'), clean_price, 'active'
  FROM sub_base WHERE k % 50 = 1
  UNION ALL
  SELECT concat('X', subscription_id), concat('X', customer_id), start_date, end_date, monthly_price, status
  FROM sub_base WHERE k % 50 = 2
)"""

RAW_EVENTS_SQL = """
ev_base AS (
  SELECT event_id AS k,
         CAST(event_id AS VARCHAR) AS event_id,
         CASE WHEN event_id % 211 = 17 THEN concat('X', cid) ELSE cid END AS customer_id,
         CASE WHEN event_id % 13 = 0 THEN concat(' ', et, ' ') ELSE et END AS event_type,
         CASE WHEN event_id % 997 = 0 THEN ''
              ELSE strftime(CAST(ts AS DATE) - to_months(CAST(276 + event_id % 72 AS INTEGER)), '%Y-%m-%d')
         END AS event_date,
         CASE WHEN event_id % 11 = 0 THEN concat(' ', src) ELSE src END AS source
  FROM (SELECT *,
               CAST(user_id * 10 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS VARCHAR) AS cid,
               CASE event_type WHEN 'view' THEN 'trial_start' WHEN 'click' THEN 'activated'
                               WHEN 'error' THEN 'churned' ELSE event_type END AS et,
               CASE event_id % 4 WHEN 0 THEN 'ads' WHEN 1 THEN 'organic' WHEN 2 THEN 'outbound'
                                 ELSE 'referral' END AS src
        FROM events) e
),
raw_events AS (
  SELECT event_id, customer_id, event_type, event_date, source FROM ev_base
  UNION ALL
  SELECT event_id, customer_id, event_type, event_date, source FROM ev_base WHERE k % 331 = 0
  UNION ALL
  SELECT concat('E', event_id), customer_id, event_type, event_date, source FROM ev_base WHERE k % 23 = 0
)"""

RAW_SQL = ",".join([RAW_CUSTOMERS_SQL, RAW_SUBSCRIPTIONS_SQL, RAW_EVENTS_SQL])
