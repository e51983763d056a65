"""Registered data checks (V*), their summary (S6) and profiles (P*)."""

from __future__ import annotations

import datetime as dt

from ..operators import profile as P
from ..operators import quality as Q
from ..sources.schemas import COLUMN_RULES, KEYS
from .registry import register
from .oracle_sql import with_ctes

# The registered future-date checks use an as-of date inside the test data's
# range (1995-2004), so the rules have offenders to find; the library default is
# the workload's own fixed date (quality.DEFAULT_AS_OF).
AS_OF = dt.date(2000, 6, 30)

TYPED_SQL = """
typed_customers AS (
  SELECT NULLIF(customer_id, '') AS customer_id,
         CAST(try_strptime(NULLIF(TRIM(signup_date), ''), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S']) AS DATE) AS signup_date,
         NULLIF(segment, '') AS segment, NULLIF(country, '') AS country,
         NULLIF(is_enterprise, '') AS is_enterprise
  FROM raw_customers
),
typed_subscriptions AS (
  SELECT NULLIF(subscription_id, '') AS subscription_id, NULLIF(customer_id, '') AS customer_id,
         CAST(try_strptime(NULLIF(TRIM(start_date), ''), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S']) AS DATE) AS start_date,
         CAST(try_strptime(NULLIF(TRIM(end_date), ''), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S']) AS DATE) AS end_date,
         TRY_CAST(TRIM(monthly_price) AS DECIMAL(10,2)) AS monthly_price,
         NULLIF(status, '') AS status
  FROM raw_subscriptions
),
typed_events AS (
  SELECT NULLIF(event_id, '') AS event_id, NULLIF(customer_id, '') AS customer_id,
         NULLIF(event_type, '') AS event_type,
         CAST(try_strptime(NULLIF(TRIM(event_date), ''), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S']) AS DATE) AS event_date,
         NULLIF(source, '') AS source
  FROM raw_events
)"""

COLUMNS = {
    "customers": ["customer_id", "signup_date", "segment", "country", "is_enterprise"],
    "subscriptions": ["subscription_id", "customer_id", "start_date", "end_date", "monthly_price", "status"],
    "events": ["event_id", "customer_id", "event_type", "event_date", "source"],
}
TYPED_TYPES = {
    "customers": ["string", "date", "string", "string", "string"],
    "subscriptions": ["string", "string", "date", "date", "decimal(10,2)", "string"],
    "events": ["string", "string", "string", "date", "string"],
}
FINAL = {"customers": "c_final", "subscriptions": "s_unique", "events": "e_unique"}
CLEAN0 = {"customers": "c_clean", "subscriptions": "s_clean", "events": "e_clean"}


def _not_in(table: str, other: str) -> str:
    return (
        f"SELECT * FROM typed_{table} t WHERE NOT EXISTS "
        f"(SELECT 1 FROM typed_{other} o WHERE o.customer_id IS NOT DISTINCT FROM t.customer_id)"
    )


def _dup_rows(table: str) -> str:
    cols = ", ".join(COLUMNS[table])
    return (
        f"SELECT {cols} FROM (SELECT *, COUNT(*) OVER (PARTITION BY {cols}) AS n FROM typed_{table}) d "
        "WHERE n > 1"
    )


def _row_counts() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM raw_{t}) AS raw_rows, "
        f"(SELECT COUNT(*) FROM {CLEAN0[t]}) AS cleaned_rows, "
        f"(SELECT COUNT(*) FROM raw_{t}) - (SELECT COUNT(*) FROM {CLEAN0[t]}) AS difference"
        for t in ("customers", "subscriptions", "events")
    )


def _null_dates() -> str:
    rows = [
        ("c_clean", "customers", "signup_date", "cleaned"),
        ("e_clean", "events", "event_date", "cleaned"),
        ("s_clean", "subscriptions", "start_date", "cleaned"),
        ("s_clean", "subscriptions", "end_date", "cleaned"),
        ("c_final", "customers", "signup_date", "final"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{s}' AS stage, "
        f"COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {src}"
        for src, t, c, s in rows
    )


def _primary_keys() -> str:
    parts = []
    for t, rel in FINAL.items():
        k = KEYS[t]
        parts.append(
            f"SELECT '{t}' AS table_name, '{k}' AS key_column, COUNT(*) AS row_count, "
            f"COUNT(DISTINCT {k}) AS distinct_keys, "
            f"(SELECT COUNT(*) FROM (SELECT {k} FROM {rel} WHERE {k} IS NOT NULL GROUP BY {k} "
            f"HAVING COUNT(*) > 1) d) AS duplicate_keys, "
            f"COUNT(*) FILTER (WHERE {k} IS NULL) AS null_keys FROM {rel}"
        )
    return "\nUNION ALL ".join(parts)


def _column_constraints() -> str:
    parts = []
    for t, rules in COLUMN_RULES.items():
        for c, (width, nullable) in rules.items():
            if not nullable:
                parts.append(
                    f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'not_null' AS rule, "
                    f"COUNT(*) FILTER (WHERE {c} IS NULL) AS violations FROM {FINAL[t]}"
                )
            if width is not None:
                parts.append(
                    f"SELECT '{t}', '{c}', 'max_length_{width}', "
                    f"COUNT(*) FILTER (WHERE length({c}) > {width}) FROM {FINAL[t]}"
                )
    return "\nUNION ALL ".join(parts)


EVENT_SEQUENCE_SQL = """
SELECT customer_id, issues FROM (
  SELECT customer_id, concat_ws(', ',
           CASE WHEN trial < signup THEN 'trial_before_signup' END,
           CASE WHEN activated < signup THEN 'activated_before_signup' END,
           CASE WHEN churned < signup THEN 'churned_before_signup' END) AS issues, signup
  FROM (SELECT customer_id,
               MIN(CASE WHEN event_type = 'signup' THEN event_date END) AS signup,
               MIN(CASE WHEN event_type = 'trial_start' THEN event_date END) AS trial,
               MIN(CASE WHEN event_type = 'activated' THEN event_date END) AS activated,
               MIN(CASE WHEN event_type = 'churned' THEN event_date END) AS churned
        FROM typed_events WHERE customer_id IS NOT NULL GROUP BY customer_id) f
) g WHERE signup IS NOT NULL AND issues <> ''"""

SIGNUP_MISMATCH_SQL = """
SELECT c.customer_id, c.signup_date, e.event_date AS event_signup_date
FROM (SELECT customer_id, signup_date FROM typed_customers WHERE signup_date IS NOT NULL) c
LEFT JOIN (SELECT customer_id, event_date FROM typed_events WHERE event_type = 'signup') e
       ON c.customer_id IS NOT DISTINCT FROM e.customer_id
WHERE c.signup_date IS DISTINCT FROM e.event_date"""

# name -> (oracle body over TYPED/CLEAN CTEs, has decimal columns, or 'flag')
CHECK_SQL: dict[str, tuple[str, bool | str]] = {
    "customers_unique": (
        "SELECT COUNT(DISTINCT customer_id) AS unique_count, COUNT(*) AS total_rows FROM typed_customers",
        False,
    ),
    "duplicate_customer_ids": (
        "SELECT * FROM typed_customers t WHERE EXISTS (SELECT 1 FROM (SELECT customer_id FROM typed_customers "
        "GROUP BY customer_id HAVING COUNT(*) > 1) d WHERE d.customer_id IS NOT DISTINCT FROM t.customer_id)",
        False,
    ),
    "dup_key_counts": (
        "SELECT customer_id, COUNT(*) AS row_count FROM c_clean GROUP BY customer_id HAVING COUNT(*) > 1",
        False,
    ),
    "dup_row_counts": (
        "SELECT customer_id, signup_date, segment, country, is_enterprise, COUNT(*) AS dup_count "
        "FROM c_clean GROUP BY ALL HAVING COUNT(*) > 1",
        "flag",
    ),
    "dup_rows_customers": (_dup_rows("customers"), False),
    "dup_rows_subscriptions": (_dup_rows("subscriptions"), True),
    "dup_rows_events": (_dup_rows("events"), False),
    "subs_invalid_customers": (_not_in("subscriptions", "customers"), True),
    "events_invalid_customers": (_not_in("events", "customers"), False),
    "invalid_prices": ("SELECT * FROM typed_subscriptions WHERE monthly_price <= 0", True),
    "invalid_dates": (
        "SELECT * FROM typed_subscriptions WHERE end_date IS NOT NULL AND start_date > end_date",
        True,
    ),
    "multiple_signups": (
        "SELECT customer_id, COUNT(*) AS count FROM typed_events WHERE event_type = 'signup' "
        "AND customer_id IS NOT NULL GROUP BY customer_id HAVING COUNT(*) > 1",
        False,
    ),
    "events_before_signup": (
        "SELECT e.*, c.signup_date FROM typed_events e JOIN typed_customers c "
        "ON e.customer_id IS NOT DISTINCT FROM c.customer_id "
        "WHERE c.signup_date IS NOT NULL AND e.event_date < c.signup_date",
        False,
    ),
    "active_with_end": (
        "SELECT * FROM typed_subscriptions WHERE status = 'active' AND end_date IS NOT NULL",
        True,
    ),
    "canceled_without_end": (
        "SELECT * FROM typed_subscriptions WHERE status = 'canceled' AND end_date IS NULL",
        True,
    ),
    "customers_no_subs": (_not_in("customers", "subscriptions"), False),
    "customers_no_events": (_not_in("customers", "events"), False),
    "subs_no_events": (_not_in("subscriptions", "events"), True),
    "future_customers": (f"SELECT * FROM typed_customers WHERE signup_date > DATE '{AS_OF}'", False),
    "future_subs_start": (f"SELECT * FROM typed_subscriptions WHERE start_date > DATE '{AS_OF}'", True),
    "future_subs_end": (f"SELECT * FROM typed_subscriptions WHERE end_date > DATE '{AS_OF}'", True),
    "future_events": (f"SELECT * FROM typed_events WHERE event_date > DATE '{AS_OF}'", False),
    "event_sequence": (EVENT_SEQUENCE_SQL, False),
    "signup_mismatch": (SIGNUP_MISMATCH_SQL, False),
    "row_counts_match": (_row_counts(), False),
    "null_dates": (_null_dates(), False),
    "primary_keys": (_primary_keys(), False),
    "column_constraints": (_column_constraints(), False),
}


def _sql(body: str) -> str:
    return with_ctes(TYPED_SQL, body)


def _register_check(name: str) -> None:
    body, dec = CHECK_SQL[name]
    register(f"check_{name}", sql=_sql(body), decimals=dec is True, flags=dec == "flag")(lambda w: Q.CHECKS[name](w, AS_OF))


for _name in CHECK_SQL:
    _register_check(_name)

_SUMMARY_SQL = "\nUNION ALL ".join(
    f"SELECT '{n}' AS check_name, (SELECT COUNT(*) FROM ({b}) s) AS rows" for n, (b, _) in CHECK_SQL.items()
)
register("check_summary", sql=_sql(_SUMMARY_SQL))(lambda w: Q.workload_summary(w, AS_OF))

# --- profiles -------------------------------------------------------------------------


def _info_sql(table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, COUNT({c}) AS non_null, COUNT(*) AS total_rows "
        f"FROM typed_{table}"
        for c, t in zip(COLUMNS[table], TYPED_TYPES[table])
    )


def _missing_sql(table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM typed_{table}"
        for c in COLUMNS[table]
    )


for _t in ("customers", "subscriptions", "events"):
    register(f"profile_info_{_t}", sql=_sql(_info_sql(_t)))((lambda t: lambda w: P.column_info(w.typed(t)))(_t))
    register(f"missing_{_t}", sql=_sql(_missing_sql(_t)))((lambda t: lambda w: P.missing_counts(w.typed(t)))(_t))


def _describe_sql(table: str, col: str, days: bool) -> str:
    x = f"CAST(date_diff('day', DATE '1970-01-01', {col}) AS DOUBLE)" if days else f"CAST({col} AS DOUBLE)"
    stats = [("count", f"CAST(COUNT({x}) AS DOUBLE)"), ("mean", f"AVG({x})")]
    if not days:
        stats.append(("std", f"STDDEV_SAMP({x})"))
    stats += [("min", f"MIN({x})"), ("max", f"MAX({x})")]
    stats += [(f"{int(q * 100)}%", f"quantile_cont({x}, {q})") for q in P.QUARTILES]
    inner = "\nUNION ALL ".join(f"SELECT '{s}' AS statistic, {e} AS value FROM typed_{table}" for s, e in stats)
    extra = (
        ", CASE WHEN statistic = 'count' THEN NULL ELSE CAST(DATE '1970-01-01' + CAST(floor(value) AS INTEGER) "
        "AS DATE) END AS value_date"
        if days
        else ""
    )
    return f"SELECT '{col}' AS column_name, statistic, round(value, 4) AS value{extra} FROM ({inner}) s"


register("profile_numeric_subscriptions", sql=_sql(_describe_sql("subscriptions", "monthly_price", False)))(
    lambda w: P.describe_numeric(w.typed("subscriptions"), "monthly_price")
)
register("profile_dates_events", sql=_sql(_describe_sql("events", "event_date", True)))(
    lambda w: P.describe_numeric(w.typed("events"), "event_date", as_days=True)
)
register(
    "profile_dates_subscriptions_start",
    sql=_sql(_describe_sql("subscriptions", "start_date", True)),
)(lambda w: P.describe_numeric(w.typed("subscriptions"), "start_date", as_days=True))

for _t, _col in (("customers", "signup_date"), ("subscriptions", "end_date")):
    register(f"profile_dates_{_t}_{_col.split('_')[0]}", sql=_sql(_describe_sql(_t, _col, True)))(
        (lambda t, c: lambda w: P.describe_numeric(w.typed(t), c, as_days=True))(_t, _col)
    )

CATEGORICAL = {
    "customers": ["customer_id", "segment", "country", "is_enterprise"],
    "subscriptions": ["subscription_id", "customer_id", "status"],
    "events": ["event_id", "customer_id", "event_type", "source"],
}


def _categorical_sql(table: str) -> str:
    long = "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM typed_{table}" for c in CATEGORICAL[table])
    return (
        "SELECT column_name, CAST(SUM(n) AS BIGINT) AS count, COUNT(*) AS unique, "
        "MAX(CASE WHEN rk = 1 THEN value END) AS top, MAX(n) AS freq FROM ("
        "SELECT column_name, value, n, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rk "
        f"FROM (SELECT column_name, value, COUNT(*) AS n FROM ({long}) l WHERE value IS NOT NULL GROUP BY column_name, value) vc) r "
        "GROUP BY column_name"
    )


for _t in CATEGORICAL:
    register(f"profile_categorical_{_t}", sql=_sql(_categorical_sql(_t)))(
        (lambda t: lambda w: P.describe_categorical(w.typed(t), CATEGORICAL[t]))(_t)
    )

VALUE_COUNTS = {
    "segment": "customers",
    "country": "customers",
    "is_enterprise": "customers",
    "status": "subscriptions",
    "price": "subscriptions",
    "event_type": "events",
    "source": "events",
}


def _ranked_counts(col: str, table: str) -> str:
    return f"SELECT {col}, COUNT(*) AS count, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {col} ASC NULLS FIRST) AS rank FROM {table} GROUP BY {col}"


for _short, _t in VALUE_COUNTS.items():
    _col = "monthly_price" if _short == "price" else _short
    register(
        f"value_counts_{_short}",
        sql=_sql(_ranked_counts(_col, f"typed_{_t}")),
        decimals=_short == "price",
    )((lambda t, c: lambda w: P.value_counts(w.typed(t), c))(_t, _col))

for _col in ("is_enterprise", "segment"):
    register(
        f"group_counts_{_col}",
        sql=_sql(_ranked_counts(_col, "c_clean")),
        flags=_col == "is_enterprise",
    )((lambda c: lambda w: P.value_counts(w.customers_clean0, c))(_col))
