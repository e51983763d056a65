"""Column expressions used across the workload (all built-in, codegen-friendly).

Cleaning helpers (blank-safe parsing, boolean text, money text) and the rate
helpers of the metric and funnel tables. Rates are computed in decimal
arithmetic: double division mis-rounds values such as 23/160 (14.375 -> 14.37).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schemas import PCT, PRICE, RATE

# Fixed values of the workload: accepted spellings of a true / false flag.
TRUE_WORDS = ("TRUE", "T", "1")
FALSE_WORDS = ("FALSE", "F", "0")
DATE_FORMAT = "yyyy-M-d"  # one or two digits of month and day
DATE_TIME_FORMAT = "yyyy-M-d HH:mm:ss"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- cleaning (C1-C7) -------------------------------------------------------


def blank_to_null(c: Column | str) -> Column:
    """Trim spaces; an empty result becomes NULL."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def parse_date(c: Column | str) -> Column:
    """Blank-safe year-month-day parse; unparsable text gives NULL, never an error."""
    return F.try_to_date(blank_to_null(c), DATE_FORMAT)


def parse_date_or_time(c: Column | str) -> Column:
    """As ``parse_date``, but text with a time of day gives its date (the typed read of the checks)."""
    return F.coalesce(parse_date(c), F.try_to_timestamp(blank_to_null(c), F.lit(DATE_TIME_FORMAT)).cast("date"))


def parse_flag(c: Column | str) -> Column:
    """Text to 0/1: TRUE/T/1 -> 1, FALSE/F/0 -> 0 (case-insensitive, trimmed), else NULL."""
    u = F.upper(F.trim(_c(c)))
    return F.when(u.isin(*TRUE_WORDS), F.lit(1)).when(u.isin(*FALSE_WORDS), F.lit(0)).cast("int")


def parse_money(c: Column | str) -> Column:
    """Trimmed text to decimal(10,2), half-up; unparsable text gives NULL."""
    return F.trim(_c(c)).try_cast(PRICE)


def fill_default(c: Column | str, default: str = "Unknown") -> Column:
    """Blank or NULL -> ``default`` (the in-place segment fix, as an expression)."""
    return F.coalesce(blank_to_null(c), F.lit(default))


# --- calendar (F1-F2) -------------------------------------------------------


def month_start(c: Column | str) -> Column:
    return F.trunc(_c(c), "MM")


def month_end(c: Column | str) -> Column:
    return F.last_day(_c(c))


# --- rates (F3-F7) ----------------------------------------------------------


def _dec(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def safe_ratio(num: Column, den: Column, integral: bool = True) -> Column:
    """``num / den`` in decimal arithmetic, NULL when ``den`` is 0 or NULL.

    Counts are widened to decimal(20,0) first; money stays decimal.
    """
    if integral:
        num, den = _dec(num), _dec(den)
    return num / F.nullif(den, F.lit(0))


def pct_uncapped(num: Column, den: Column, integral: bool = True) -> Column:
    """``round(coalesce(num / nullif(den, 0), 0) * 100, 2)`` as decimal(18,2)."""
    return F.round(F.coalesce(safe_ratio(num, den, integral), F.lit(0)) * 100, 2).cast(RATE)


def _rounded_pct(num: Column, den: Column) -> Column:
    return F.round(safe_ratio(num, den) * 100, 2)


def capped_pct(num: Column, den: Column) -> Column:
    """Conversion %, capped at 100, and 0 when the denominator is 0.

    Spark's ``least`` skips NULLs (least(NULL, 100) = 100), so the zero
    denominator is tested explicitly instead of relying on NULL propagation.
    """
    return F.when(den == 0, F.lit(0)).otherwise(F.least(_rounded_pct(num, den), F.lit(100))).cast(PCT)


def dropoff_pct(num: Column, den: Column) -> Column:
    """100 - capped %, and 0 (not 100) when the denominator is 0."""
    return (
        F.when(den == 0, F.lit(0))
        .otherwise(F.lit(100) - F.least(_rounded_pct(num, den), F.lit(100)))
        .cast(PCT)
    )


def retention_pct(num: Column, den: Column) -> Column:
    """100 - capped %, floored at 0, and 0 when the denominator is 0."""
    return (
        F.when(den == 0, F.lit(0))
        .otherwise(F.greatest(F.lit(100) - F.least(_rounded_pct(num, den), F.lit(100)), F.lit(0)))
        .cast(PCT)
    )


# Fixed values of the workload: the four anomaly rules of a funnel row, in order.
FLAG_PAID_GT_ACTIVATED = "paid > activated"
FLAG_PAID_GT_TRIALS = "paid > trials"
FLAG_CHURNED_GT_PAID = "churned > paid"
FLAG_NO_SIGNUPS = "no signups but later stages"
FLAG_CONSISTENT = "consistent"


def funnel_flag(signups: Column, trials: Column, activated: Column, paid: Column, churned: Column) -> Column:
    """Comma-joined list of the rules a row breaks, or 'consistent'."""
    text = F.concat_ws(
        ", ",
        F.when(paid > activated, F.lit(FLAG_PAID_GT_ACTIVATED)),
        F.when(paid > trials, F.lit(FLAG_PAID_GT_TRIALS)),
        F.when(churned > paid, F.lit(FLAG_CHURNED_GT_PAID)),
        F.when((signups == 0) & ((trials > 0) | (activated > 0) | (paid > 0)), F.lit(FLAG_NO_SIGNUPS)),
    )
    return F.when(text == "", F.lit(FLAG_CONSISTENT)).otherwise(text)
