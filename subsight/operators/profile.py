"""Profiling (P1-P7): column info, describe (numeric / categorical / dates),
value counts and missing counts. Every statistic is one aggregate pass; wide
results are turned long with ``stack`` so they read as (column, statistic, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import with_rank
from .quantile import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _stack(wide: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS ({key}, {value})")


def column_info(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null, total_rows) for every column, from one aggregate."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = ", ".join(f"'{c}', `{c}`, `__rows`" for c in df.columns)
    long = wide.selectExpr(f"stack({len(df.columns)}, {cells}) AS (column_name, non_null, total_rows)")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dtype = F.lit(None).cast("string")
    for name, t in types.items():
        dtype = F.when(F.col("column_name") == name, F.lit(t)).otherwise(dtype)
    return long.select("column_name", dtype.alias("data_type"), "non_null", "total_rows")


def describe_numeric(
    df: DataFrame, column: str, as_days: bool = False, approx_accuracy: int | None = None
) -> DataFrame:
    """Count, mean, std (n - 1), min, 25 %, 50 %, 75 %, max of one column.

    ``as_days`` describes a date column as days since 1970-01-01 (and omits std,
    as a data-frame describe does for dates). Quartiles are exact (interpolated)
    by default; ``approx_accuracy`` switches to ``percentile_approx`` with that
    accuracy (one pass, mergeable sketches, relative rank error 1/accuracy).
    """
    x = F.unix_date(F.col(column)).cast("double") if as_days else F.col(column).cast("double")
    stats = df.agg(
        F.count(x).cast("double").alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    names = ["count", "mean"] + ([] if as_days else ["std"]) + ["min", "max"]
    long = _stack(stats, names, "statistic", "value")
    if approx_accuracy:
        qs = df.agg(F.percentile_approx(x, list(QUARTILES), approx_accuracy).alias("q")).select(
            F.posexplode("q").alias("i", "quantile")
        )
        q = qs.select(F.element_at(F.array(*[F.lit(p) for p in QUARTILES]), F.col("i") + 1).alias("prob"), "quantile")
    else:
        q = exact_quantiles(df, x, QUARTILES)
    q = q.select(
        F.concat((F.col("prob") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
        F.col("quantile").alias("value"),
    )
    out = long.unionByName(q).select(
        F.lit(column).alias("column_name"), "statistic", F.round("value", 4).alias("value")
    )
    if as_days:
        out = out.withColumn(
            "value_date",
            F.when(F.col("statistic") == "count", F.lit(None).cast("date")).otherwise(
                F.date_from_unix_date(F.floor("value").cast("int"))
            ),
        )
    return out


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, unique, top (most frequent; ties -> smallest value), freq per text column.

    All columns are stacked into (column_name, value) and counted in *one* shuffle.
    """
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    long = _stack(df.select(*columns), columns, "column_name", "value").filter(F.col("value").isNotNull())
    vc = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return vc.groupBy("column_name").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top"),
        F.max("n").alias("freq"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count, rank) including NULL; rank 1 is the most frequent value (ties by value, NULL first)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return with_rank(counts, F.desc("count"), F.asc(column))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, missing_count) for every column, in one aggregate."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _stack(wide, df.columns, "column_name", "missing_count")
