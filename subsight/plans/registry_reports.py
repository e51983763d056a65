"""Registered dashboard reports (B1-B10) with their DuckDB oracles."""

from __future__ import annotations

from itertools import combinations

from ..operators import report as R
from . import oracle_sql as O
from .registry import register

CM = "cm AS (" + O.CORE_METRICS_SELECT + ")"
FP = "fp AS (" + O.funnel_rates_select("stages") + ")"

SLICE = {"segment": ["BUILDING", "FURNITURE"], "source": ["ads", "organic"]}


def _q(*parts: str) -> str:
    return O.with_ctes(O.MONTHS_SQL, O.METRICS_SQL, O.FUNNEL_SQL, CM, FP, *parts)


def signed_pct(a: str, b: str) -> str:
    """round_half_up(100 * a / b, 2) for money a of any sign and b > 0; NULL when b is NULL or 0."""
    A, B = f"CAST(({a}) * 100 AS HUGEINT)", f"CAST(({b}) * 100 AS HUGEINT)"
    return (
        f"CAST(CASE WHEN {B} IS NULL OR {B} = 0 THEN NULL "
        f"ELSE CAST(sign({A}) * ((20000 * abs({A}) + {B}) // (2 * {B})) AS DECIMAL(20,0)) * 0.01 END "
        "AS DECIMAL(18,2))"
    )


SUMS = (
    "CAST(SUM(mrr) AS DECIMAL(22,2)) AS mrr, CAST(SUM(arr) AS DECIMAL(22,2)) AS arr, "
    "CAST(SUM(active_customers) AS BIGINT) AS active_customers, "
    "CAST(SUM(churned_logos) AS BIGINT) AS churned_logos, CAST(SUM(lost_mrr) AS DECIMAL(22,2)) AS lost_mrr"
)
ARPC = O.round_money_div("mrr", "active_customers") + " AS arpc"

_sets = ", ".join(
    "(" + ", ".join(["month_start", *c]) + ")" for r in range(4) for c in combinations(R.DIMS, r)
)
register(
    "report_metrics_cube",
    decimals=True,
    sql=_q(
        f"""SELECT *, {ARPC} FROM (
  SELECT month_start, segment, country, source,
         CAST(GROUPING(month_start, segment, country, source) AS BIGINT) AS grouping_id, {SUMS}
  FROM cm GROUP BY GROUPING SETS ({_sets})) g"""
    ),
)(lambda w: R.metrics_cube(w.core_metrics()))

_where = " AND ".join(f"{c} IN (" + ", ".join(f"'{v}'" for v in vs) + ")" for c, vs in SLICE.items())
register(
    "report_metrics_sliced",
    decimals=True,
    sql=_q(f"SELECT *, {ARPC} FROM (SELECT month_start, {SUMS} FROM cm WHERE {_where} GROUP BY month_start) g"),
)(lambda w: R.metrics_sliced(w.core_metrics(), **SLICE))

register(
    "report_mrr_growth",
    decimals=True,
    sql=_q(
        f"""SELECT month_start, mrr, arr, active_customers,
       {signed_pct('mrr - LAG(mrr) OVER w', 'LAG(mrr) OVER w')} AS growth_vs_prev_pct,
       {signed_pct('mrr - FIRST_VALUE(mrr) OVER w', 'FIRST_VALUE(mrr) OVER w')} AS growth_vs_first_pct
FROM (SELECT month_start, CAST(SUM(mrr) AS DECIMAL(22,2)) AS mrr, CAST(SUM(arr) AS DECIMAL(22,2)) AS arr,
             CAST(SUM(active_customers) AS BIGINT) AS active_customers FROM cm GROUP BY month_start) m
WINDOW w AS (ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    ),
)(lambda w: R.mrr_growth(w.core_metrics()))


def _churn_sql(dims: list[str]) -> str:
    keys = ", ".join(["month_start", *dims])
    part = f"PARTITION BY {', '.join(dims)} " if dims else ""
    return _q(
        f"""SELECT {keys}, churned_logos, lost_mrr, active_customers, mrr,
       {O.round_pct('churned_logos', 'LAG(active_customers) OVER w')} AS logo_churn_rate_pct,
       {O.round_pct('lost_mrr', 'LAG(mrr) OVER w', money=True)} AS revenue_churn_rate_pct
FROM (SELECT {keys}, CAST(SUM(churned_logos) AS BIGINT) AS churned_logos,
             CAST(SUM(lost_mrr) AS DECIMAL(22,2)) AS lost_mrr,
             CAST(SUM(active_customers) AS BIGINT) AS active_customers,
             CAST(SUM(mrr) AS DECIMAL(22,2)) AS mrr FROM cm GROUP BY {keys}) m
WINDOW w AS ({part}ORDER BY month_start)"""
    )


register("report_overall_churn", decimals=True, sql=_churn_sql([]))(lambda w: R.churn_by(w.core_metrics()))
for _dim in ("segment", "country", "source"):
    register(f"report_churn_by_{_dim}", decimals=True, sql=_churn_sql([_dim]))(
        (lambda d: lambda w: R.churn_by(w.core_metrics(), (d,)))(_dim)
    )
register(
    "report_arpc_by_segment",
    decimals=True,
    sql=_q(
        f"""SELECT *, {ARPC} FROM (SELECT month_start, segment, CAST(SUM(mrr) AS DECIMAL(22,2)) AS mrr,
       CAST(SUM(active_customers) AS BIGINT) AS active_customers FROM cm GROUP BY month_start, segment) g"""
    ),
)(lambda w: R.arpc_by(w.core_metrics()))


def _funnel_by_sql(key: str) -> str:
    sums = ", ".join(f"CAST(SUM({t}) AS BIGINT) AS {t}" for t in R.TOTALS)
    return _q(
        f"fs AS (SELECT {key}, {sums} FROM fp GROUP BY {key})",
        O.funnel_rates_select("fs", keys=key),
    )


register("report_funnel_by_month", decimals=True, sql=_funnel_by_sql("month_start"))(
    lambda w: R.funnel_by(w.funnel_performance(), ["month_start"])
)
for _dim in ("source", "segment", "country"):
    register(f"report_funnel_by_{_dim}", decimals=True, sql=_funnel_by_sql(_dim))(
        (lambda d: lambda w: R.funnel_by(w.funnel_performance(), [d]))(_dim)
    )

FUNNEL_SLICE = {"data_flag": ["consistent"], "source": ["ads", "organic"]}
_fwhere = " AND ".join(f"{c} IN (" + ", ".join(f"'{v}'" for v in vs) + ")" for c, vs in FUNNEL_SLICE.items())
register(
    "report_funnel_sliced",
    decimals=True,
    sql=_q(
        "fs AS (SELECT month_start, " + ", ".join(f"CAST(SUM({t}) AS BIGINT) AS {t}" for t in R.TOTALS)
        + f" FROM fp WHERE {_fwhere} GROUP BY month_start)",
        O.funnel_rates_select("fs", keys="month_start"),
    ),
)(lambda w: R.funnel_sliced(w.funnel_performance(), **FUNNEL_SLICE))

_stage_rows = "\nUNION ALL ".join(
    f"SELECT month_start, {i + 1} AS stage_order, '{s}' AS stage, {t} AS stage_count FROM s"
    for i, (s, t) in enumerate(zip(R.STAGES, R.TOTALS))
)
_pct_prev = (
    "CASE WHEN LAG(stage_count) OVER w IS NULL THEN CAST(100 AS DECIMAL(18,2)) ELSE "
    + O.round_pct("stage_count", "LAG(stage_count) OVER w")
    + " END"
)
register(
    "report_funnel_stages",
    decimals=True,
    sql=_q(
        "s AS (SELECT month_start, " + ", ".join(f"CAST(SUM({t}) AS BIGINT) AS {t}" for t in R.TOTALS)
        + " FROM fp GROUP BY month_start)",
        f"l AS ({_stage_rows})",
        f"""SELECT month_start, CAST(stage_order AS INTEGER) AS stage_order, stage, stage_count,
       {_pct_prev} AS pct_of_previous, CAST(100 - {_pct_prev} AS DECIMAL(18,2)) AS dropoff_pct
FROM l WINDOW w AS (PARTITION BY month_start ORDER BY stage_order)""",
    ),
)(lambda w: R.funnel_stages(w.funnel_performance()))

register(
    "report_thresholds",
    decimals=True,
    sql=_q(
        f"""SELECT month_start, segment, country, source, logo_churn_rate_pct,
       CASE WHEN logo_churn_rate_pct > {R.HIGH_CHURN_PCT} THEN 'high churn' ELSE 'normal' END AS churn_label
FROM cm"""
    ),
)(lambda w: R.churn_thresholds(w.core_metrics()))
register(
    "report_retention_thresholds",
    decimals=True,
    sql=_q(
        f"""SELECT month_start, segment, country, source, paid_retention_pct,
       CASE WHEN paid_retention_pct > {R.HIGH_RETENTION_PCT} THEN 'high retention' ELSE 'normal' END
         AS retention_label
FROM fp"""
    ),
)(lambda w: R.retention_thresholds(w.funnel_performance()))
register(
    "report_flag_share",
    decimals=True,
    sql=_q(
        "SELECT data_flag, rows, "
        + O.round_pct("rows", "SUM(rows) OVER ()")
        + " AS pct_of_rows FROM (SELECT data_flag, COUNT(*) AS rows FROM fp GROUP BY data_flag) g"
    ),
)(lambda w: R.flag_share(w.funnel_performance()))
