"""Joins on keys of which one may hold a third of all rows, without relying on runtime re-planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on.
HOT_ROWS = 1 << 20
#: Hot keys there can be at most, so the table of them may be broadcast.
MOST_HOT = 4096


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(_hot, _salts)``: keys of many rows, and over how many tasks each is to be spread.

    Hot are keys of at least ``hot_rows`` rows and of at least 1 / ``MOST_HOT`` of all: no more than
    ``MOST_HOT`` keys, whatever the size of the table.
    """
    limit = F.greatest(F.lit(hot_rows), F.ceil(df.agg(F.count(F.lit(1)).alias("n")).scalar() / MOST_HOT))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    salts = F.ceil(F.col("_rows") / limit).cast("int")
    return counts.filter(F.col("_rows") >= limit).select(F.col(key).alias("_hot"), salts.alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, right_key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``left`` and ``right`` on equal keys, NULL like any other; ``left`` may be skewed.

    Rows of a hot key on the left are dealt over salts; its rows on the right are copied for each salt.
    """
    hot = hot_keys(left, key, hot_rows)
    dealt = left.join(F.broadcast(hot), left[key].eqNullSafe(hot["_hot"]), "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0)).cast("int")).drop("_hot", "_salts")
    again = hot_keys(left, key, hot_rows)
    copied = right.join(F.broadcast(again), right[right_key].eqNullSafe(again["_hot"]), "left")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)).alias("_copy")
    copied = copied.select(*right.columns, each)
    met = dealt.join(copied, dealt[key].eqNullSafe(copied[right_key]) & (dealt["_salt"] == copied["_copy"]))
    return met.drop("_salt", "_copy")
