"""Monthly recurring revenue and churn by cell.

A *cell* is (month_start, segment, country, source). Everything is
pre-aggregated per customer before it meets the customer dimension, so one
customer holding a large share of subscriptions or events collapses in the
map-side partial aggregate and never lands in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.schemas import MONEY, RATE
from .calendar import active_spans
from .cleaning import ACTIVE, CANCELED, CHURNED

CELL = ["month_start", "segment", "country", "source"]
DIM_COLS = ["customer_id", "segment", "country", "source"]


def cells_of(dim: DataFrame) -> DataFrame:
    """The distinct cells of each customer: repeated customer rows are one, so they count and pay once."""
    return dim.select(*DIM_COLS).distinct()


# --- revenue: deltas and running sums instead of month x subscription rows ------------
#
# A subscription active from month f to month l adds +price at f and -price at
# l + 1 month. Summing those deltas per (customer, month) - a map-side combinable
# aggregate, so a customer owning millions of subscriptions still ships at most
# one row per delta month from each task - and running them forward per customer
# gives the customer's active-subscription count and MRR in every month, as a few
# constant *segments*. Segments then become +1/+mrr and -1/-mrr deltas per cell,
# whose running sums give the cell's active customers and MRR. Every window is
# partitioned by one customer or one cell and holds at most one row per calendar
# month. Work is O(subscriptions + cells x months): no subscription is ever
# expanded into its months.


def _running(w: Window):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def customer_deltas(subs: DataFrame, lo, hi) -> DataFrame:
    """(customer_id, month_start, dn, dp): change in active subscriptions and MRR."""
    s = active_spans(subs, lo, hi, status=ACTIVE)
    price = F.coalesce(F.col("monthly_price"), F.lit(0).cast("decimal(10,2)"))
    ev = F.explode(
        F.array(
            F.struct(F.col("_f").alias("m"), F.lit(1).alias("dn"), price.alias("dp")),
            F.struct(F.add_months("_l", 1).alias("m"), F.lit(-1).alias("dn"), (-price).alias("dp")),
        )
    )
    d = s.select("customer_id", ev.alias("e")).select("customer_id", "e.*").filter(F.col("m") <= hi)
    return d.groupBy("customer_id", F.col("m").alias("month_start")).agg(
        F.sum("dn").alias("dn"), F.sum("dp").alias("dp")
    )


def customer_segments(deltas: DataFrame, hi) -> DataFrame:
    """(customer_id, seg_start, seg_end, mrr): maximal runs of months with >= 1 active subscription
    and constant MRR (adjacent runs may share values)."""
    w = Window.partitionBy("customer_id").orderBy("month_start")
    run = deltas.select(
        "customer_id",
        "month_start",
        F.sum("dn").over(_running(w)).alias("n"),
        F.sum("dp").over(_running(w)).alias("mrr"),
        F.lead("month_start").over(w).alias("next_start"),
    )
    return run.filter(F.col("n") > 0).select(
        "customer_id",
        F.col("month_start").alias("seg_start"),
        F.coalesce(F.add_months("next_start", -1), hi).alias("seg_end"),
        "mrr",
    )


def customer_segments_of(subs: DataFrame, lo, hi) -> DataFrame:
    return customer_segments(customer_deltas(subs, lo, hi), hi)


def customer_month_revenue(subs: DataFrame, lo, hi) -> DataFrame:
    """(customer_id, month_start, mrr) for every month a customer is active (output-sized)."""
    seg = customer_segments_of(subs, lo, hi)
    return seg.select(
        "customer_id", F.explode(F.sequence("seg_start", "seg_end", F.expr("INTERVAL 1 MONTH"))).alias("month_start"),
        "mrr",
    )


def active_customers_by_month(segments: DataFrame, dim: DataFrame) -> DataFrame:
    """M3: (month, customer, segment, country, source) with an active subscription at month end.

    Inner join: subscriptions of customers missing from the customer table drop out.
    """
    j = segments.join(cells_of(dim), "customer_id")
    return j.select(
        F.explode(F.sequence("seg_start", "seg_end", F.expr("INTERVAL 1 MONTH"))).alias("month_start"),
        "customer_id",
        "segment",
        "country",
        "source",
    )


def revenue_by_cell(segments: DataFrame, dim: DataFrame, hi) -> DataFrame:
    """M4: mrr, arr = 12 x mrr, and active customers per cell and month."""
    j = segments.join(cells_of(dim), "customer_id")
    ev = F.explode(
        F.array(
            F.struct(F.col("seg_start").alias("m"), F.lit(1).alias("dc"), F.col("mrr").alias("dm")),
            F.struct(F.add_months("seg_end", 1).alias("m"), F.lit(-1).alias("dc"), (-F.col("mrr")).alias("dm")),
        )
    )
    keys = CELL[1:]
    d = (
        j.select(*keys, ev.alias("e"))
        .select(*keys, "e.*")
        .filter(F.col("m") <= hi)
        .groupBy(*keys, F.col("m").alias("month_start"))
        .agg(F.sum("dc").alias("dc"), F.sum("dm").alias("dm"))
    )
    w = Window.partitionBy(*keys).orderBy("month_start")
    run = d.select(
        *keys,
        "month_start",
        F.sum("dc").over(_running(w)).alias("active_customers"),
        F.sum("dm").over(_running(w)).alias("mrr"),
        F.lead("month_start").over(w).alias("next_start"),
    ).filter(F.col("active_customers") > 0)
    months = F.sequence(
        "month_start", F.coalesce(F.add_months("next_start", -1), hi), F.expr("INTERVAL 1 MONTH")
    )
    return run.select(
        F.explode(months).alias("month_start"),
        *keys,
        F.col("mrr").cast(MONEY).alias("mrr"),
        (F.col("mrr") * 12).cast(MONEY).alias("arr"),
        F.col("active_customers").cast("bigint").alias("active_customers"),
    )


def churn_by_customer_month(events: DataFrame, subs: DataFrame) -> DataFrame:
    """The churn fan-out, computed per (customer, month) without emitting pairs.

    The workload's churn base joins each customer to *every* churned event and
    *every* canceled subscription with an end date, keeps rows where either date
    is set, dates the row by the event (else the end date) and sums the
    subscription price over all rows. A customer with e churned events and s
    canceled subscriptions therefore contributes e x s rows. That product is
    reproduced exactly from per-month counts and sums on each side:

    * a dated event in month m carries every canceled price once:
      rows = k_m * max(s, 1), lost = k_m * P_total;
    * canceled subscriptions ending in month m' appear once per *undated*
      churned event, or once if the customer has no churned event at all:
      rows = mult * n_m', lost = mult * P_m'.

    Work is linear in events + subscriptions, whatever the fan-out.
    """
    ev = (
        events.filter(F.col("event_type") == CHURNED)
        .groupBy("customer_id", S.month_start("event_date").alias("month_start"))
        .agg(F.count(F.lit(1)).alias("k"))
        .select("customer_id", "month_start", "k", F.lit(None).cast("decimal(20,2)").alias("p"),
                F.lit(None).cast("bigint").alias("n"))
    )
    sb = (
        subs.filter((F.col("status") == CANCELED) & F.col("end_date").isNotNull())
        .groupBy("customer_id", S.month_start("end_date").alias("month_start"))
        .agg(F.sum("monthly_price").alias("p"), F.count(F.lit(1)).alias("n"))
        .select("customer_id", "month_start", F.lit(None).cast("bigint").alias("k"), "p", "n")
    )
    # Per-customer totals by a window over the customer's (at most two per month)
    # aggregated rows: no self-joins.
    w = Window.partitionBy("customer_id")
    both = ev.unionByName(sb).select(
        "*",
        F.sum("k").over(w).alias("n_e"),
        F.sum(F.when(F.col("month_start").isNull(), F.col("k"))).over(w).alias("n_null"),
        F.sum("p").over(w).alias("p_tot"),
        F.sum("n").over(w).alias("n_s"),
    )
    is_event = F.col("k").isNotNull()
    mult = F.when(F.col("n_e").isNull(), F.lit(1)).otherwise(F.coalesce("n_null", F.lit(0)))
    rows = F.when(is_event, F.col("k") * F.coalesce("n_s", F.lit(1))).otherwise(mult * F.col("n"))
    lost = F.when(is_event, F.col("k") * F.col("p_tot")).otherwise(mult * F.col("p"))
    keep = F.when(is_event, F.col("month_start").isNotNull()).otherwise(mult > 0)
    return (
        both.filter(keep)
        .groupBy("customer_id", "month_start")
        .agg(F.sum(rows).alias("fanout_rows"), F.sum(lost).alias("lost"))
    )


def churn_base(churn_cm: DataFrame, dim: DataFrame) -> DataFrame:
    """M5: churned customers per month with their cell, fan-out row count and lost MRR.

    The fan-out starts from customer rows, so each repeat of a customer row repeats it.
    """
    cells = dim.groupBy(*DIM_COLS).agg(F.count(F.lit(1)).alias("copies"))
    return churn_cm.join(cells, "customer_id").select(
        "month_start",
        "customer_id",
        "segment",
        "country",
        "source",
        (F.col("fanout_rows") * F.col("copies")).cast("bigint").alias("fanout_rows"),
        F.coalesce(F.col("lost") * F.col("copies"), F.lit(0)).cast(MONEY).alias("lost_mrr"),
    )


def churned_by_cell(base: DataFrame) -> DataFrame:
    """M6: churned logos (distinct customers) and lost MRR per cell."""
    return base.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("churned_logos"),
        F.coalesce(F.sum("lost_mrr"), F.lit(0)).cast(MONEY).alias("lost_mrr"),
    )


def cell_facts(segments: DataFrame, churn_cm: DataFrame, dim: DataFrame, hi) -> DataFrame:
    """Per cell and month of any change: ``dc``, ``dm`` (change in active customers and MRR), ``churned_logos``, ``lost_mrr``.

    Revenue and churn of the customers meet the customer dimension in one join. A customer row that
    repeats counts once in revenue and once for each repeat in the churn fan-out.
    """
    ev = F.explode(
        F.array(
            F.struct(F.col("seg_start").alias("m"), F.lit(1).alias("dc"), F.col("mrr").alias("dm")),
            F.struct(F.add_months("seg_end", 1).alias("m"), F.lit(-1).alias("dc"), (-F.col("mrr")).alias("dm")),
        )
    )
    none = F.lit(None)
    revenue = segments.select("customer_id", ev.alias("e")).filter(F.col("e.m") <= hi).select(
        "customer_id", F.col("e.m").alias("month_start"), F.col("e.dc").cast("bigint").alias("dc"), F.col("e.dm").alias("dm"),
        none.cast("bigint").alias("logo"), none.cast("decimal(38,2)").alias("lost"),
    )
    churn = churn_cm.select(
        "customer_id", "month_start", none.cast("bigint").alias("dc"), none.cast(revenue.schema["dm"].dataType).alias("dm"),
        F.lit(1).cast("bigint").alias("logo"), F.col("lost").cast("decimal(38,2)").alias("lost"),
    )
    cells = dim.groupBy(*DIM_COLS).agg(F.count(F.lit(1)).alias("copies"))
    return (
        revenue.unionByName(churn)
        .join(cells, "customer_id")
        .groupBy(*CELL)
        .agg(
            F.coalesce(F.sum("dc"), F.lit(0)).alias("dc"),
            F.coalesce(F.sum("dm"), F.lit(0)).alias("dm"),
            F.coalesce(F.sum("logo"), F.lit(0)).alias("churned_logos"),
            F.coalesce(F.sum(F.col("lost") * F.col("copies")), F.lit(0)).cast(MONEY).alias("lost_mrr"),
        )
    )


def with_rates(cells: DataFrame) -> DataFrame:
    """Cells and their churn with both rates against the cell's previous *existing* row, and ARPC.

    One window spec serves both lags: one shuffle, one sort, partitioned by the cell key.
    """
    own = Window.partitionBy(*CELL[1:]).orderBy("month_start")
    return cells.select(
        "*",
        S.pct_uncapped(F.col("churned_logos"), F.lag("active_customers").over(own)).alias("logo_churn_rate_pct"),
        S.pct_uncapped(F.col("lost_mrr"), F.lag("mrr").over(own), integral=False).alias("revenue_churn_rate_pct"),
        F.round(S.safe_ratio(F.col("mrr"), F.col("active_customers").cast("decimal(20,0)"), integral=False), 2).cast(RATE).alias("arpc"),
    )


def with_churn_rates(revenue: DataFrame, churned: DataFrame) -> DataFrame:
    """M7 from two finished frames (M4 and M6): left join on the four keys with plain equality (a NULL key
    never matches), so churn in a month without a revenue cell is dropped, as in the workload."""
    cells = revenue.join(churned, CELL, "left").select(
        *CELL,
        "mrr",
        "arr",
        "active_customers",
        F.coalesce(F.col("churned_logos"), F.lit(0)).cast("bigint").alias("churned_logos"),
        F.coalesce(F.col("lost_mrr"), F.lit(0)).cast(MONEY).alias("lost_mrr"),
    )
    return with_rates(cells)


def metrics_of(facts: DataFrame, hi) -> DataFrame:
    """M7: the cells with revenue, month by month, with their churn and rates.

    A cell's changes are summed up in month order and filled to the next change. Churn in a month
    without revenue is dropped; so is that of a cell with a NULL key, which equals no key in the
    workload. ``lag`` is the previous *existing* row of the cell, not the previous calendar month.
    All windows are partitioned by the cell: one shuffle, never a global window.
    """
    own = Window.partitionBy(*CELL[1:]).orderBy("month_start")
    run = facts.select(
        "*",
        F.sum("dc").over(_running(own)).alias("active_customers"),
        F.sum("dm").over(_running(own)).alias("mrr"),
        F.lead("month_start").over(own).alias("next_start"),
    ).filter(F.col("active_customers") > 0)
    months = F.sequence("month_start", F.coalesce(F.add_months("next_start", -1), hi), F.expr("INTERVAL 1 MONTH"))
    filled = run.withColumn("_m", F.explode(months))
    # churn belongs to the month of the change; months filled in have none
    here = (F.col("_m") == F.col("month_start")) & F.col("segment").isNotNull() & F.col("country").isNotNull() & F.col("source").isNotNull()
    cells = filled.select(
        F.col("_m").alias("month_start"),
        *CELL[1:],
        F.col("mrr").cast(MONEY).alias("mrr"),
        (F.col("mrr") * 12).cast(MONEY).alias("arr"),
        F.col("active_customers").cast("bigint").alias("active_customers"),
        F.when(here, F.col("churned_logos")).otherwise(0).cast("bigint").alias("churned_logos"),
        F.when(here, F.col("lost_mrr")).otherwise(0).cast(MONEY).alias("lost_mrr"),
    )
    return with_rates(cells)


def core_metrics(subs: DataFrame, events: DataFrame, dim: DataFrame, lo, hi) -> DataFrame:
    """The monthly metrics table, ordered by month, segment, country, source.

    ``lo``/``hi`` are the calendar bounds (``calendar.spine_bounds``), as values or scalar subqueries.
    """
    facts = cell_facts(customer_segments_of(subs, lo, hi), churn_by_customer_month(events, subs), dim, hi)
    return metrics_of(facts, hi).orderBy(*CELL)
