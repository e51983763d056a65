"""Named queries: a Spark builder and (where SQL can say it) the DuckDB oracle text.

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole of the driver tables found in ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import funnel as N
from ..operators import metrics as M
from ..operators.ordering import with_rank
from . import oracle_sql as O
from ..sources.sinks import preview
from .workload import Workload

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


# Decimal columns of the workload (all of scale 2). The library computes and returns decimals; at
# this contract boundary both sides give them as text of fixed scale, which is exact at any size.
DECIMAL_COLUMNS = (
    "monthly_price", "mrr", "arr", "lost_mrr", "logo_churn_rate_pct", "revenue_churn_rate_pct", "arpc",
    "signup_to_trial_pct", "signup_dropoff_pct", "trial_to_activated_pct", "trial_dropoff_pct",
    "activated_to_paid_pct", "activated_dropoff_pct", "paid_to_churn_pct", "paid_retention_pct",
    "growth_vs_prev_pct", "growth_vs_first_pct", "pct_of_previous", "dropoff_pct", "pct_of_rows",
)
# A nullable integer flag: pandas shows Spark's as float64 and DuckDB's as a nullable int, so both are DOUBLE.
FLAG_COLUMNS = ("is_enterprise",)


def contract_columns(df: DataFrame) -> DataFrame:
    def shown(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("decimal(38,2)").cast("string").alias(f.name)
        flag = f.name in FLAG_COLUMNS and isinstance(f.dataType, T.IntegerType)
        return F.col(f.name).cast("double").alias(f.name) if flag else F.col(f.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def oracle_columns(sql: str, flags: bool = False) -> str:
    """The oracle's result with the same columns shown the same way (a result has decimals or the flag, not both)."""
    names = ", ".join(f"'{c}'" for c in (FLAG_COLUMNS if flags else DECIMAL_COLUMNS))
    own = f"COLUMNS(lambda c: c IN ({names}))"
    shown = f"CAST({own} AS DOUBLE)" if flags else f"CAST(CAST({own} AS DECIMAL(38,2)) AS VARCHAR)"
    return f"SELECT COLUMNS(lambda c: c NOT IN ({names})), {shown}\nFROM (\n{sql}\n) q"


def register(name: str, sql: str | None = None, decimals: bool = False, flags: bool = False):
    """Register ``fn(workload) -> DataFrame`` as query ``name``.

    ``decimals``: the result has decimal columns (text of fixed scale on both sides);
    ``flags``: it has the nullable flag column.
    """

    def deco(fn: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Workload.from_testdata(spark, sf_dir))
            return contract_columns(df) if decimals or flags else df

        build.__name__ = name
        build.__doc__ = fn.__doc__
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = oracle_columns(sql, flags) if decimals or flags else sql
        return fn

    return deco


def _q(*parts: str) -> str:
    return O.with_ctes(*parts)


# --- sources and cleaning ------------------------------------------------------

for _t in ("customers", "subscriptions", "events"):
    register(f"raw_{_t}", _q(f"SELECT * FROM raw_{_t}"))((lambda t: lambda w: w.raw[t])(_t))


@register(
    "load_row_counts",
    _q(
        """SELECT 'customers' AS table_name, COUNT(*) AS row_count FROM raw_customers
UNION ALL SELECT 'subscriptions', COUNT(*) FROM raw_subscriptions
UNION ALL SELECT 'events', COUNT(*) FROM raw_events"""
    ),
)
def load_row_counts(w: Workload) -> DataFrame:
    """Row count of each landed table."""
    parts = [w.raw[t].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
             for t in ("customers", "subscriptions", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


register("clean_customers", flags=True, sql=_q("SELECT * FROM c_clean"))(lambda w: w.customers_clean0)
register("clean_subscriptions", decimals=True, sql=_q("SELECT * FROM s_clean"))(lambda w: w.subscriptions_clean0)
register("clean_events", _q("SELECT * FROM e_clean"))(lambda w: w.events_clean0)
register("dedup_events", _q("SELECT * FROM e_unique"))(lambda w: w.events)
register("dedup_subscriptions", decimals=True, sql=_q("SELECT * FROM s_unique"))(lambda w: w.subscriptions)
register("customers_override_signup", flags=True, sql=_q("SELECT * FROM c_final"))(lambda w: w.customers)
register("preview_customers", flags=True, sql=_q("SELECT * FROM c_final ORDER BY customer_id LIMIT 5"))(
    lambda w: preview(w.customers, "customer_id", 5)
)
register(
    "customer_acquisition_source",
    _q("SELECT customer_id, source FROM c_cell"),
)(lambda w: w.dim.select("customer_id", "source"))

# --- calendar and metrics ------------------------------------------------------------

register("month_spine", _q(O.MONTHS_SQL, "SELECT month_start, month_end FROM months"))(
    lambda w: w.month_spine()
)


register("active_customers_by_month", _q(O.MONTHS_SQL, O.METRICS_SQL, "SELECT * FROM active"))(
    lambda w: M.active_customers_by_month(w.customer_segments(), w.dim)
)

register(
    "revenue_by_cell",
    decimals=True,
    sql=_q(
        O.MONTHS_SQL,
        O.METRICS_SQL,
        """SELECT month_start, segment, country, source, CAST(mrr AS DECIMAL(22,2)) AS mrr,
       CAST(arr AS DECIMAL(22,2)) AS arr, active_customers FROM revenue""",
    ),
)(lambda w: w.revenue_by_cell())

register(
    "churn_base",
    decimals=True,
    sql=_q(
        O.MONTHS_SQL,
        O.METRICS_SQL,
        """SELECT month_start, customer_id, segment, country, source, COUNT(*) AS fanout_rows,
       CAST(COALESCE(SUM(price), 0) AS DECIMAL(22,2)) AS lost_mrr
FROM lost GROUP BY month_start, customer_id, segment, country, source""",
    ),
)(lambda w: w.churn_base())

register(
    "churned_by_cell",
    decimals=True,
    sql=_q(
        O.MONTHS_SQL,
        O.METRICS_SQL,
        """SELECT month_start, segment, country, source, churned_logos,
       CAST(lost_mrr AS DECIMAL(22,2)) AS lost_mrr FROM lost_cell""",
    ),
)(lambda w: M.churned_by_cell(w.churn_base()))



def _ranked_sql(select: str) -> str:
    """O1: the rows of ``select`` with their place in the order of the cell keys."""
    return f"SELECT *, ROW_NUMBER() OVER (ORDER BY {', '.join(f'{c} ASC NULLS FIRST' for c in M.CELL)}) AS rank FROM (\n{select}\n) r"


register("core_metrics", _q(O.MONTHS_SQL, O.METRICS_SQL, _ranked_sql(O.CORE_METRICS_SELECT)), decimals=True)(
    lambda w: with_rank(w.core_metrics(), *M.CELL)
)

register(
    "logo_churn_rate",
    decimals=True,
    sql=_q(O.MONTHS_SQL, O.METRICS_SQL, "cm AS (" + O.CORE_METRICS_SELECT + ")",
       "SELECT month_start, segment, country, source, churned_logos, active_customers, logo_churn_rate_pct FROM cm"),
)(lambda w: w.core_metrics().select(*M.CELL, "churned_logos", "active_customers", "logo_churn_rate_pct"))

register(
    "revenue_churn_rate",
    decimals=True,
    sql=_q(O.MONTHS_SQL, O.METRICS_SQL, "cm AS (" + O.CORE_METRICS_SELECT + ")",
       "SELECT month_start, segment, country, source, lost_mrr, mrr, revenue_churn_rate_pct FROM cm"),
)(lambda w: w.core_metrics().select(*M.CELL, "lost_mrr", "mrr", "revenue_churn_rate_pct"))

# --- funnel --------------------------------------------------------------------------

register("customer_funnel_base", _q(O.FUNNEL_SQL, "SELECT * FROM people"))(
    lambda w: w.funnel_base()
)
register("funnel_counts", _q(O.FUNNEL_SQL, "SELECT * FROM stages"))(
    lambda w: N.funnel_counts(w.funnel_base())
)
register(
    "funnel_rates",
    decimals=True,
    sql=_q(O.FUNNEL_SQL, "fr AS (" + O.funnel_rates_select("stages") + ")",
       "SELECT * EXCLUDE (data_flag) FROM fr"),
)(lambda w: N.funnel_rates(N.funnel_counts(w.funnel_base())))
register(
    "funnel_flags",
    _q(O.FUNNEL_SQL, "fr AS (" + O.funnel_rates_select("stages") + ")",
       "SELECT month_start, segment, country, source, total_signups, total_trials, total_activated, "
       "total_paid, total_churned, data_flag FROM fr"),
)(lambda w: N.funnel_flags(N.funnel_counts(w.funnel_base())))
register("funnel_performance", _q(O.FUNNEL_SQL, _ranked_sql(O.funnel_rates_select("stages"))), decimals=True)(
    lambda w: with_rank(w.funnel_performance(), *N.CELL)
)
