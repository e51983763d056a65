"""The order of a result as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_rank(df: DataFrame, *by: Column, name: str = "rank") -> DataFrame:
    """``df`` with its row number in the order of ``by`` (bigint, from 1), which must tell rows apart.

    Range partitions are sorted and written with the place of each row in its partition; the
    partitions' row counts, summed up in order, say where each begins. The only window holds
    one row for each partition, so no task has all rows.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(width, *by).sortWithinPartitions(*by)
    kept = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")  # partition above 33 bits, row below
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = kept.withColumn("_own", part).join(F.broadcast(starts), F.col("_own") == F.col("_part"))  # a row for each partition
    return placed.select(*df.columns, (F.col("_at") + F.col("_shift") + 1).alias(name))
