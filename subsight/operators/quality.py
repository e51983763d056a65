"""Data checks (V1-V26). Each rule returns the *offending rows* (or a count frame).

Rules from the validation script run on the *typed* read (empty text -> NULL,
dates and price parsed, nothing trimmed); rules from the SQL script run on the
cleaned tables. Membership tests follow the script's null semantics: a NULL key
matches a NULL key (``eqNullSafe``), so a NULL id is never "unknown" when the
other side also has one.

Scale notes: the right side of every anti / semi test is first reduced to its
distinct keys (a partial aggregate), so a customer with a third of all rows is a
single row there; a skewed left side is split by adaptive skew-join handling.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import COLUMN_RULES, KEYS
from .cleaning import ACTIVATED, ACTIVE, CANCELED, CHURNED, SIGNUP, TRIAL
from .expand import expand_counts
from .skew import HOT_ROWS, salted_join

# Fixed value of the workload: the "today" of the future-date rules.
DEFAULT_AS_OF = dt.date(2026, 1, 9)


def _keys(df: DataFrame, col: str = "customer_id") -> DataFrame:
    return df.select(F.col(col).alias("_k")).distinct()


def _anti(left: DataFrame, right_keys: DataFrame, col: str = "customer_id") -> DataFrame:
    return left.join(right_keys, left[col].eqNullSafe(right_keys["_k"]), "left_anti")


# --- uniqueness and duplicates -------------------------------------------------


def customers_unique(customers: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """V1: distinct ids vs rows (one row). Exact by default; ``approx_rsd`` uses
    ``approx_count_distinct`` (HyperLogLog++, that relative standard deviation)."""
    distinct = (
        F.approx_count_distinct("customer_id", approx_rsd) if approx_rsd else F.count_distinct("customer_id")
    )
    return customers.agg(distinct.alias("unique_count"), F.count(F.lit(1)).alias("total_rows"))


def duplicate_key_rows(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """V2: every row whose key occurs more than once (NULL keys count as one key)."""
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_k"))
    return df.join(dup, df[key].eqNullSafe(dup["_k"]), "left_semi")


def duplicate_key_counts(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """V3: keys seen more than once, with their row count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def duplicate_row_counts(df: DataFrame) -> DataFrame:
    """V4: whole-row duplicates with their count."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("dup_count")).filter("dup_count > 1")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """V5: every copy of each whole-row duplicate (count, then re-expand in chunks)."""
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return expand_counts(counts, "_n")


# --- referential integrity and coverage -----------------------------------------


def unknown_customer(df: DataFrame, customers: DataFrame) -> DataFrame:
    """V6 / V7: rows whose customer_id is not in the customer table."""
    return _anti(df, _keys(customers))


def customers_without(customers: DataFrame, other: DataFrame) -> DataFrame:
    """Customers absent from ``other`` (subscriptions or events)."""
    return _anti(customers, _keys(other))


def subscriptions_without_events(subs: DataFrame, events: DataFrame) -> DataFrame:
    """Subscriptions whose customer has no event at all."""
    return _anti(subs, _keys(events))


# --- row rules ---------------------------------------------------------------------
#
# Each row rule is a predicate on one typed table. The check itself is
# ``filter(predicate)``; the summary counts every rule of a table in one pass.


def _pred_invalid_prices(a):
    return F.col("monthly_price") <= 0


def _pred_invalid_dates(a):
    return F.col("end_date").isNotNull() & (F.col("start_date") > F.col("end_date"))


def _pred_active_with_end(a):
    return (F.col("status") == ACTIVE) & F.col("end_date").isNotNull()


def _pred_canceled_without_end(a):
    return (F.col("status") == CANCELED) & F.col("end_date").isNull()


def _pred_future(column):
    return lambda a: F.col(column) > F.lit(a)


ROW_RULES = {
    "invalid_prices": ("subscriptions", _pred_invalid_prices),
    "invalid_dates": ("subscriptions", _pred_invalid_dates),
    "active_with_end": ("subscriptions", _pred_active_with_end),
    "canceled_without_end": ("subscriptions", _pred_canceled_without_end),
    "future_customers": ("customers", _pred_future("signup_date")),
    "future_subs_start": ("subscriptions", _pred_future("start_date")),
    "future_subs_end": ("subscriptions", _pred_future("end_date")),
    "future_events": ("events", _pred_future("event_date")),
}


def invalid_prices(subs: DataFrame) -> DataFrame:
    """V8: price <= 0 (a NULL price is not an offender here)."""
    return subs.filter(_pred_invalid_prices(None))


def invalid_dates(subs: DataFrame) -> DataFrame:
    """V9: start after end."""
    return subs.filter(_pred_invalid_dates(None))


def active_with_end(subs: DataFrame) -> DataFrame:
    """V12."""
    return subs.filter(_pred_active_with_end(None))


def canceled_without_end(subs: DataFrame) -> DataFrame:
    """V13."""
    return subs.filter(_pred_canceled_without_end(None))


def future_dates(df: DataFrame, column: str, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Rows dated after ``as_of``."""
    return df.filter(_pred_future(column)(as_of))


# --- event rules -----------------------------------------------------------------------


def multiple_signups(events: DataFrame) -> DataFrame:
    """Customers with more than one signup event, and how many (NULL ids dropped)."""
    return (
        events.filter((F.col("event_type") == SIGNUP) & F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter("count > 1")
    )


def _dated_customers(customers: DataFrame) -> DataFrame:
    return customers.filter(F.col("signup_date").isNotNull()).select(
        F.col("customer_id").alias("_k"), "signup_date"
    )


def events_before_signup(events: DataFrame, customers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events dated strictly before the customer's signup date; a hot customer's events are dealt over salts."""
    j = salted_join(events, _dated_customers(customers), "customer_id", "_k", hot_rows)
    return j.filter(F.col("event_date") < F.col("signup_date")).select(*events.columns, "signup_date")


def event_sequence(events: DataFrame) -> DataFrame:
    """Customers whose first trial / activation / churn precedes their first signup.

    One aggregate per customer (the script loops over customers and rescans the
    event log each time). Customers without a signup event are skipped.
    """
    t, d = F.col("event_type"), F.col("event_date")
    firsts = (
        events.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(*[F.min(F.when(t == k, d)).alias(k) for k in (SIGNUP, TRIAL, ACTIVATED, CHURNED)])
        .filter(F.col(SIGNUP).isNotNull())
    )
    issues = F.concat_ws(
        ", ",
        *[F.when(F.col(k) < F.col(SIGNUP), F.lit(f"{label}_before_signup")) for k, label in
          ((TRIAL, "trial"), (ACTIVATED, "activated"), (CHURNED, "churned"))],
    )
    return firsts.select("customer_id", issues.alias("issues")).filter(F.col("issues") != "")


def signup_mismatch(customers: DataFrame, events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Dated customers whose signup event date differs, one row per signup event;
    a customer with no signup event is a mismatch too (its event date is NULL).

    Written as inner join + anti join rather than one left join, so that the signup events of
    a hot customer are dealt over salts; the anti join meets distinct keys only.
    """
    c = _dated_customers(customers)
    s = events.filter(F.col("event_type") == SIGNUP).select("customer_id", F.col("event_date").alias("event_signup_date"))
    matched = salted_join(s, c, "customer_id", "_k", hot_rows).filter(~F.col("signup_date").eqNullSafe(F.col("event_signup_date")))
    matched = matched.select(F.col("_k").alias("customer_id"), "signup_date", "event_signup_date")
    unmatched = _anti(c.withColumnRenamed("_k", "customer_id"), _keys(s)).withColumn("event_signup_date", F.lit(None).cast("date"))
    return matched.unionByName(unmatched)


# --- SQL-script checks on the cleaned tables ---------------------------------------------------


def row_counts_match(raw: dict[str, DataFrame], cleaned: dict[str, DataFrame]) -> DataFrame:
    """Raw vs cleaned (pre-dedup) row counts per table, with the difference."""
    parts = [
        raw[t].agg(F.count(F.lit(1)).alias("raw_rows")).select(
            F.lit(t).alias("table_name"),
            "raw_rows",
            cleaned[t].agg(F.count(F.lit(1))).scalar().alias("cleaned_rows"),
        )
        for t in ("customers", "subscriptions", "events")
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("difference", F.col("raw_rows") - F.col("cleaned_rows"))


def null_dates(customers0: DataFrame, subs0: DataFrame, events0: DataFrame, customers: DataFrame) -> DataFrame:
    """NULL date counts after cleaning, plus the final signup check after the override; one scan of each."""

    def nulls(df: DataFrame, table: str, stage: str, *cols: str) -> DataFrame:
        wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        cells = ", ".join(f"'{c}', `{c}`" for c in cols)
        long = wide.selectExpr(f"stack({len(cols)}, {cells}) AS (column_name, null_count)")
        return long.select(F.lit(table).alias("table_name"), "column_name", F.lit(stage).alias("stage"), "null_count")

    parts = [
        nulls(customers0, "customers", "cleaned", "signup_date"),
        nulls(events0, "events", "cleaned", "event_date"),
        nulls(subs0, "subscriptions", "cleaned", "start_date", "end_date"),
        nulls(customers, "customers", "final", "signup_date"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Key report per table: rows, distinct keys, keys seen twice or more, NULL keys."""
    parts = []
    for name, df in tables.items():
        key = KEYS[name]
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(
            per_key.agg(
                F.sum("_n").alias("row_count"),
                F.count(F.col(key)).alias("distinct_keys"),
                F.count_if(F.col(key).isNotNull() & (F.col("_n") > 1)).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)).alias("null_keys"),
            ).select(F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), "*")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        "table_name", "key_column", F.col("row_count").cast("bigint").alias("row_count"), "distinct_keys",
        "duplicate_keys", F.col("null_keys").cast("bigint").alias("null_keys"),
    )


def column_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """NOT NULL and width violations per declared column rule (one aggregate per table)."""
    parts = []
    for name, df in tables.items():
        aggs, labels = [], []
        for col, (width, nullable) in COLUMN_RULES[name].items():
            if not nullable:
                aggs.append(F.count_if(F.col(col).isNull()).alias(f"{col}__not_null"))
                labels.append((col, "not_null"))
            if width is not None:
                aggs.append(F.count_if(F.length(F.col(col)) > width).alias(f"{col}__max_length_{width}"))
                labels.append((col, f"max_length_{width}"))
        wide = df.agg(*aggs)
        stack = ", ".join(f"'{c}', '{r}', `{c}__{r}`" for c, r in labels)
        parts.append(
            wide.selectExpr(f"stack({len(labels)}, {stack}) AS (column_name, rule, violations)").select(
                F.lit(name).alias("table_name"), "column_name", "rule", "violations"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """S6 re-aimed: (check_name, rows) for every check, empty ones included (rows = 0)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check_name"), "rows")
        for name, df in checks.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# name -> builder(workload, as_of): each check builds only what it reads.
CHECKS = {
    "customers_unique": lambda w, a: customers_unique(w.typed("customers")),
    "duplicate_customer_ids": lambda w, a: duplicate_key_rows(w.typed("customers")),
    "dup_key_counts": lambda w, a: duplicate_key_counts(w.customers_clean0),
    "dup_row_counts": lambda w, a: duplicate_row_counts(w.customers_clean0),
    "dup_rows_customers": lambda w, a: duplicate_rows(w.typed("customers")),
    "dup_rows_subscriptions": lambda w, a: duplicate_rows(w.typed("subscriptions")),
    "dup_rows_events": lambda w, a: duplicate_rows(w.typed("events")),
    "subs_invalid_customers": lambda w, a: unknown_customer(w.typed("subscriptions"), w.typed("customers")),
    "events_invalid_customers": lambda w, a: unknown_customer(w.typed("events"), w.typed("customers")),
    "invalid_prices": lambda w, a: invalid_prices(w.typed("subscriptions")),
    "invalid_dates": lambda w, a: invalid_dates(w.typed("subscriptions")),
    "multiple_signups": lambda w, a: multiple_signups(w.typed("events")),
    "events_before_signup": lambda w, a: events_before_signup(w.typed("events"), w.typed("customers")),
    "active_with_end": lambda w, a: active_with_end(w.typed("subscriptions")),
    "canceled_without_end": lambda w, a: canceled_without_end(w.typed("subscriptions")),
    "customers_no_subs": lambda w, a: customers_without(w.typed("customers"), w.typed("subscriptions")),
    "customers_no_events": lambda w, a: customers_without(w.typed("customers"), w.typed("events")),
    "subs_no_events": lambda w, a: subscriptions_without_events(w.typed("subscriptions"), w.typed("events")),
    "future_customers": lambda w, a: future_dates(w.typed("customers"), "signup_date", a),
    "future_subs_start": lambda w, a: future_dates(w.typed("subscriptions"), "start_date", a),
    "future_subs_end": lambda w, a: future_dates(w.typed("subscriptions"), "end_date", a),
    "future_events": lambda w, a: future_dates(w.typed("events"), "event_date", a),
    "event_sequence": lambda w, a: event_sequence(w.typed("events")),
    "signup_mismatch": lambda w, a: signup_mismatch(w.typed("customers"), w.typed("events")),
    "row_counts_match": lambda w, a: row_counts_match(
        w.raw,
        {"customers": w.customers_clean0, "subscriptions": w.subscriptions_clean0, "events": w.events_clean0},
    ),
    "null_dates": lambda w, a: null_dates(w.customers_clean0, w.subscriptions_clean0, w.events_clean0, w.customers),
    "primary_keys": lambda w, a: primary_keys(
        {"customers": w.customers, "subscriptions": w.subscriptions, "events": w.events}
    ),
    "column_constraints": lambda w, a: column_constraints(
        {"customers": w.customers, "subscriptions": w.subscriptions, "events": w.events}
    ),
}


def all_checks(w, as_of: dt.date = DEFAULT_AS_OF) -> dict[str, DataFrame]:
    """Every check of a workload, by name (lazy frames)."""
    return {name: build(w, as_of) for name, build in CHECKS.items()}


def key_presence(customers: DataFrame, subs: DataFrame, events: DataFrame) -> DataFrame:
    """One row per customer id (NULL: one of its own) of the three typed tables: which tables carry it, and
    what the checks across tables need to know of its dates.

    ``customers``, ``subscriptions``, ``events`` and ``signups`` count rows; ``first_<type>`` are the first
    dates by event type; ``before_signup`` and ``mismatches`` count the rows of V11 and V22. Each table is
    read once. Rows are counted by id and date before anything is shuffled, and the only window
    holds one row per date of one id; no join pairs customers with events.
    """
    t = F.col("event_type")
    kinds = (SIGNUP, TRIAL, ACTIVATED, CHURNED)
    counted = ["customers", "subscriptions", "events", *kinds]

    def facts(df: DataFrame, date, **n) -> DataFrame:
        return df.select(F.col("customer_id").alias("k"), date.alias("d"), *[n.get(c, F.lit(0)).cast("bigint").alias(c) for c in counted])

    rows = (
        facts(customers, F.col("signup_date"), customers=F.lit(1))
        .unionByName(facts(subs, F.lit(None).cast("date"), subscriptions=F.lit(1)))
        .unionByName(facts(events, F.col("event_date"), events=F.lit(1), **{k: F.when(t == k, 1).otherwise(0) for k in kinds}))
    )
    dated = rows.groupBy("k", "d").agg(*[F.sum(c).alias(c) for c in counted])
    own = Window.partitionBy("k")
    later = own.orderBy(F.col("d").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    d, signups = F.col("d"), F.sum(SIGNUP).over(own)
    before = F.when(d.isNotNull(), F.col("events") * F.coalesce(F.sum("customers").over(later), F.lit(0))).otherwise(0)
    mismatch = F.when(d.isNotNull(), F.col("customers") * F.when(signups == 0, 1).otherwise(signups - F.col(SIGNUP))).otherwise(0)
    return (
        dated.select("*", before.alias("before"), mismatch.alias("mismatch"))
        .groupBy("k")
        .agg(
            *[F.sum(c).alias(c) for c in ("customers", "subscriptions", "events")],
            F.sum(SIGNUP).alias("signups"),
            *[F.min(F.when(F.col(c) > 0, d)).alias(f"first_{c}") for c in kinds],
            F.sum("before").alias("before_signup"),
            F.sum("mismatch").alias("mismatches"),
        )
    )


def _long(wide: DataFrame, names: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS (check_name, rows)")


def _total(of, when=None):
    """Sum of ``of`` over the rows where ``when`` holds; 0 of none."""
    return F.coalesce(F.sum(of if when is None else F.when(when, of)), F.lit(0)).cast("bigint")


def _presence_counts(w) -> DataFrame:
    has = {c: F.col(c) > 0 for c in ("customers", "subscriptions", "events")}
    first = F.col(f"first_{SIGNUP}")
    late = [F.coalesce(F.col(f"first_{k}") < first, F.lit(False)) for k in (TRIAL, ACTIVATED, CHURNED)]
    known = F.col("k").isNotNull()
    counts = {
        "duplicate_customer_ids": _total(F.col("customers"), F.col("customers") > 1),
        "subs_invalid_customers": _total(F.col("subscriptions"), ~has["customers"]),
        "events_invalid_customers": _total(F.col("events"), ~has["customers"]),
        "multiple_signups": F.count_if(known & (F.col("signups") > 1)),
        "events_before_signup": _total(F.col("before_signup")),
        "customers_no_subs": _total(F.col("customers"), ~has["subscriptions"]),
        "customers_no_events": _total(F.col("customers"), ~has["events"]),
        "subs_no_events": _total(F.col("subscriptions"), ~has["events"]),
        "event_sequence": F.count_if(known & first.isNotNull() & (late[0] | late[1] | late[2])),
        "signup_mismatch": _total(F.col("mismatches")),
    }
    present = key_presence(w.typed("customers"), w.typed("subscriptions"), w.typed("events"))
    return _long(present.agg(*[c.alias(n) for n, c in counts.items()]), list(counts))


def _row_rule_counts(w, table: str, as_of: dt.date) -> DataFrame:
    """Row rules and whole-row duplicates of a table: equal rows are counted first, each rule then adds counts."""
    rules = {name: rule(as_of) for name, (t, rule) in ROW_RULES.items() if t == table}
    df, n = w.typed(table), F.col("_n")
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    wide = rows.agg(_total(n, n > 1).alias(f"dup_rows_{table}"), *[_total(n, rule).alias(name) for name, rule in rules.items()])
    return _long(wide, [f"dup_rows_{table}", *rules])


def _clean_customer_counts(w) -> DataFrame:
    df, n = w.customers_clean0, F.col("_n")
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    keys = rows.groupBy("customer_id").agg(F.sum(n).alias("_n"), F.count_if(n > 1).alias("_repeated"))
    wide = keys.agg(F.count_if(n > 1).alias("dup_key_counts"), _total(F.col("_repeated")).alias("dup_row_counts"))
    return _long(wide, ["dup_key_counts", "dup_row_counts"])


def report_rows() -> dict[str, int]:
    """Checks that are reports of fixed form: their rows, whatever the data."""
    rules = sum((not nullable) + (width is not None) for rules in COLUMN_RULES.values() for width, nullable in rules.values())
    return {"customers_unique": 1, "row_counts_match": len(KEYS), "null_dates": 5, "primary_keys": len(KEYS), "column_constraints": rules}


def workload_summary(w, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """(check_name, rows) for every check in few passes: the same numbers as ``summary(all_checks(w))``.

    * checks across tables come from ``key_presence``, which reads each table once;
    * row rules and duplicates come from one pass of each table, and one of the cleaned customers;
    * a report of fixed form has as many rows as its form says.
    """
    fixed = report_rows()
    parts = [_presence_counts(w), *[_row_rule_counts(w, t, as_of) for t in ("customers", "subscriptions", "events")]]
    parts.append(_clean_customer_counts(w))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    form = F.explode(F.create_map(*[F.lit(x) for name, n in fixed.items() for x in (name, n)])).alias("check_name", "rows")
    reports = w.raw["customers"].sparkSession.range(1).select(form).select("check_name", F.col("rows").cast("bigint").alias("rows"))
    return out.unionByName(reports)
