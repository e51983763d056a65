"""Exact quantiles (linear interpolation, as a data-frame ``describe``) without
gathering the column into one task or the driver, whatever its distribution.

Spark's exact ``percentile`` merges a map of every distinct value in a single
final task. Here:

1. value counts are written once (``groupBy(v).count()``: a hot value is one row);
2. the order of doubles is that of their bits, read as an integer. Ranks are narrowed down 16 bits
   at a time: counts of the 65,536 possible next digits say in which digit a rank falls, and
   only values of that digit are counted by the digits after it. After four rounds the value is known.

A task orders at most one round's digits for one rank, never a share of the values, so neither
outliers nor crowded values make it larger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bits of a double narrowed down in one round.
DIGIT = 16


def ordered_bits(v: Column) -> Column:
    """A bigint that orders as the double ``v``: its bits, those after the sign turned over where it is negative."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def value_counts_of(df: DataFrame, value: Column) -> DataFrame:
    """``(v, c, k)`` of the values that are not NULL, written: value, rows, ordered bits."""
    v = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    counted = v.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    return cut_lineage(counted.withColumn("k", ordered_bits(F.col("v"))), "value-counts")


def narrowed(counted: DataFrame, asked: DataFrame, shift: int) -> DataFrame:
    """``asked`` (``prob, i, frac, prefix, rank``) one digit further; ``v`` is the least value of the digit.

    ``prefix`` has the bits above the digit, ``rank`` counts from the first value that begins with it.
    """
    own = counted.withColumn("prefix", F.shiftright("k", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("bigint"))
    digit, sums = F.shiftright("k", shift).alias("digit"), (F.sum("c").alias("held"), F.min("v").alias("v"))
    asked = F.broadcast(asked)  # two rows for each probability
    if shift + DIGIT < 64:
        met = own.join(asked, "prefix").groupBy(*asked.columns, digit).agg(*sums)
    else:  # all values are asked for: add them up first
        met = own.groupBy("prefix", digit).agg(*sums).join(asked, "prefix")
    upto = Window.partitionBy("prob", "i").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("held").over(upto) - F.col("held")
    found = met.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("held")))
    return found.select("prob", "i", "frac", F.col("digit").alias("prefix"), (F.col("rank") - F.col("before")).alias("rank"), "v")


def exact_quantiles(df: DataFrame, value: Column, probs: Sequence[float]) -> DataFrame:
    """One row per probability: (prob, quantile double); no row when the column is all NULL."""
    counted = value_counts_of(df, value)
    n = counted.agg(F.sum("c").alias("n")).filter(F.col("n").isNotNull())
    ranks = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(i).alias("i")) for p in probs for i in (0, 1)]))
    h = (F.col("n") - 1) * F.col("r.prob")
    last = F.least(F.floor(h) + F.col("r.i"), F.col("n") - 1)
    asked = n.select("n", ranks.alias("r")).select("r.prob", "r.i", (h - F.floor(h)).alias("frac"), F.lit(0).cast("bigint").alias("prefix"), last.alias("rank"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        asked = narrowed(counted, asked.drop("v"), shift)
    ends = asked.groupBy("prob").agg(F.max(F.when(F.col("i") == 0, F.col("v"))).alias("x0"), F.max(F.when(F.col("i") == 1, F.col("v"))).alias("x1"), F.max("frac").alias("frac"))
    between = F.when(F.col("frac") == 0, F.col("x0")).otherwise(F.col("x0") + F.col("frac") * (F.col("x1") - F.col("x0")))
    return ends.select("prob", between.alias("quantile"))
