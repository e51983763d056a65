"""Dashboard roll-ups (B1-B10) over the two product tables.

Every report re-aggregates *sums* and recomputes ratios from them (never averages
cell rates). All inputs are already aggregated to cells, so these frames are
small; the few ordered windows without a partition run over one row per month,
per stage or per flag value - sizes fixed by the calendar, not by the data.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.schemas import MONEY, RATE
from .funnel import TOTALS, rates_and_flags

DIMS = ("segment", "country", "source")


def _money_sums() -> list:
    return [
        F.sum("mrr").cast(MONEY).alias("mrr"),
        F.sum("arr").cast(MONEY).alias("arr"),
        F.sum("active_customers").cast("bigint").alias("active_customers"),
        F.sum("churned_logos").cast("bigint").alias("churned_logos"),
        F.sum("lost_mrr").cast(MONEY).alias("lost_mrr"),
    ]


def _arpc() -> F.Column:
    return (
        F.round(S.safe_ratio(F.col("mrr"), F.col("active_customers").cast("decimal(20,0)"), integral=False), 2)
        .cast(RATE)
        .alias("arpc")
    )


def metrics_cube(cm: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """B1: every subset of ``dims`` per month (grouping sets), with ``grouping_id``.

    A rolled-up dimension reads NULL; ``grouping_id`` tells it apart from a real
    NULL key (bit 2 = segment, 1 = country, 0 = source; 7 = whole month).
    """
    sets = [["month_start", *c] for r in range(len(dims) + 1) for c in combinations(dims, r)]
    g = cm.groupingSets(sets, "month_start", *dims).agg(*_money_sums(), F.grouping_id().alias("grouping_id"))
    return g.select("month_start", *dims, "grouping_id", "mrr", "arr", "active_customers", "churned_logos",
                    "lost_mrr", _arpc())


def metrics_sliced(cm: DataFrame, **slicers: list[str]) -> DataFrame:
    """B2: keep the rows matching every slicer (column -> allowed values), then total per month."""
    f = cm
    for col, values in slicers.items():
        f = f.filter(F.col(col).isin(list(values)))
    return f.groupBy("month_start").agg(*_money_sums()).select("*", _arpc())


def _signed_growth(now: F.Column, base: F.Column) -> F.Column:
    return F.round((now - base) / F.nullif(base, F.lit(0)) * 100, 2).cast(RATE)


def mrr_growth(cm: DataFrame) -> DataFrame:
    """MRR / ARR per month with growth vs the previous and the first month."""
    m = cm.groupBy("month_start").agg(
        F.sum("mrr").cast(MONEY).alias("mrr"),
        F.sum("arr").cast(MONEY).alias("arr"),
        F.sum("active_customers").cast("bigint").alias("active_customers"),
    )
    w = Window.orderBy("month_start")
    first = F.first("mrr").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return m.select(
        "*",
        _signed_growth(F.col("mrr"), F.lag("mrr").over(w)).alias("growth_vs_prev_pct"),
        _signed_growth(F.col("mrr"), first).alias("growth_vs_first_pct"),
    )


def churn_by(cm: DataFrame, dims: tuple[str, ...] = ()) -> DataFrame:
    """B4 (no dims) / B5: churn recomputed from sums: sum churned / previous sum active, etc."""
    m = cm.groupBy("month_start", *dims).agg(
        F.sum("churned_logos").cast("bigint").alias("churned_logos"),
        F.sum("lost_mrr").cast(MONEY).alias("lost_mrr"),
        F.sum("active_customers").cast("bigint").alias("active_customers"),
        F.sum("mrr").cast(MONEY).alias("mrr"),
    )
    w = (Window.partitionBy(*dims) if dims else Window).orderBy("month_start")
    return m.select(
        "*",
        S.pct_uncapped(F.col("churned_logos"), F.lag("active_customers").over(w)).alias("logo_churn_rate_pct"),
        S.pct_uncapped(F.col("lost_mrr"), F.lag("mrr").over(w), integral=False).alias("revenue_churn_rate_pct"),
    )


def arpc_by(cm: DataFrame, dims: tuple[str, ...] = ("segment",)) -> DataFrame:
    """ARPC = sum MRR / sum active customers, per month and ``dims``."""
    return (
        cm.groupBy("month_start", *dims)
        .agg(F.sum("mrr").cast(MONEY).alias("mrr"), F.sum("active_customers").cast("bigint").alias("active_customers"))
        .select("*", _arpc())
    )


def funnel_by(fp: DataFrame, keys: list[str]) -> DataFrame:
    """Funnel totals summed over ``keys``, then rates and flag recomputed on the sums."""
    sums = fp.groupBy(*keys).agg(*[F.sum(t).cast("bigint").alias(t) for t in TOTALS])
    return rates_and_flags(sums, keys)


def funnel_sliced(fp: DataFrame, keys: list[str] | None = None, **slicers: list[str]) -> DataFrame:
    """B2 on the funnel: keep rows matching every slicer (e.g. data_flag, source), then
    re-total per ``keys`` (default: month) and recompute rates and flag on the sums."""
    f = fp
    for col, values in slicers.items():
        f = f.filter(F.col(col).isin(list(values)))
    return funnel_by(f, keys or ["month_start"])


STAGES = ("signup", "trial", "activated", "paid", "churned")


def funnel_stages(fp: DataFrame) -> DataFrame:
    """One row per (month, stage): count, % of the previous stage, drop-off."""
    sums = fp.groupBy("month_start").agg(*[F.sum(t).cast("bigint").alias(t) for t in TOTALS])
    pairs = ", ".join(f"{i + 1}, '{s}', `{t}`" for i, (s, t) in enumerate(zip(STAGES, TOTALS)))
    long = sums.selectExpr("month_start", f"stack({len(STAGES)}, {pairs}) AS (stage_order, stage, stage_count)")
    w = Window.partitionBy("month_start").orderBy("stage_order")
    prev = F.lag("stage_count").over(w)
    pct = F.when(prev.isNull(), F.lit(100).cast(RATE)).otherwise(S.pct_uncapped(F.col("stage_count"), prev))
    return long.select(
        "month_start",
        F.col("stage_order").cast("int").alias("stage_order"),
        "stage",
        "stage_count",
        pct.alias("pct_of_previous"),
    ).withColumn("dropoff_pct", (F.lit(100) - F.col("pct_of_previous")).cast(RATE))


# Fixed values of the workload: dashboard threshold lines.
HIGH_CHURN_PCT = 10
HIGH_RETENTION_PCT = 90


def churn_thresholds(cm: DataFrame) -> DataFrame:
    """Label metric cells whose logo churn is above the line."""
    return cm.select(
        "month_start", *DIMS, "logo_churn_rate_pct",
        F.when(F.col("logo_churn_rate_pct") > HIGH_CHURN_PCT, F.lit("high churn")).otherwise(F.lit("normal"))
        .alias("churn_label"),
    )


def retention_thresholds(fp: DataFrame) -> DataFrame:
    """Label funnel cells whose paid retention is above the line."""
    return fp.select(
        "month_start", *DIMS, "paid_retention_pct",
        F.when(F.col("paid_retention_pct") > HIGH_RETENTION_PCT, F.lit("high retention"))
        .otherwise(F.lit("normal"))
        .alias("retention_label"),
    )


def flag_share(fp: DataFrame) -> DataFrame:
    """Funnel rows per data_flag and their share of all rows.

    The total comes from a window over the flag groups (at most 16 flag texts),
    not from a cross join.
    """
    g = fp.groupBy("data_flag").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())
    return g.select(
        "data_flag", "rows",
        F.round(F.col("rows").cast("decimal(20,0)") / total.cast("decimal(20,0)") * 100, 2).cast(RATE)
        .alias("pct_of_rows"),
    )
