"""Registered loads: CSV in several layouts, what became of its lines, replaced and swapped tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table_path
from ..sources import sinks, staging
from ..sources.schemas import KEYS, STAGING
from .oracle_sql import with_ctes
from .registry import register
from .workload import Workload

TABLES = tuple(STAGING)
#: Ids with such an end are written once more as a line with a field too many.
MALFORMED_END = "7"


def write_drop(w: Workload, folder: str) -> None:
    """The raw trio as CSV drops: half of the rows in the declared column order, half in the reverse order
    beside a column that nobody asked for, and some lines again with a field too many."""
    for table, df in w.raw.items():
        path, names, key = os.path.join(folder, table), STAGING[table].fieldNames(), F.col(KEYS[table])
        odd = F.coalesce(F.crc32(F.encode(key, "UTF-8")) % 2 == 1, F.lit(False))
        sinks.write_csv(df.where(~odd), path, names)
        sinks.write_csv(df.where(odd).withColumn("note", F.lit("not, asked for")), path, ["note", *reversed(names)])
        broken = df.where(key.endswith(MALFORMED_END)).withColumn(names[-1], F.lit("one,more"))
        sinks.write_csv(broken, path, names, quote="\u0000")


def _drop(w: Workload) -> tuple[object, str]:
    spark = w.raw["customers"].sparkSession
    folder = scratch_table_path(spark, "csv-drop")
    write_drop(w, folder)
    return spark, folder


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _column_sql(table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, COUNT(NULLIF({c}, '')) AS filled, "
        f"CAST(COALESCE(SUM(length({c})), 0) AS BIGINT) AS total_length, COUNT(DISTINCT NULLIF({c}, '')) AS distinct_values FROM raw_{table}"
        for c in STAGING[table].fieldNames()
    )


@register("csv_by_name", with_ctes("\nUNION ALL ".join(map(_column_sql, TABLES))))
def csv_by_name(w: Workload) -> DataFrame:
    """Every column of the trio as read back from files of two column orders."""
    spark, folder = _drop(w)
    parts = []
    for table in TABLES:
        df = staging.read_staging_csv(spark, os.path.join(folder, table), table)
        each = {c: F.struct(F.count(F.lit(1)), F.count(F.nullif(F.col(c), F.lit(""))), F.coalesce(F.sum(F.length(c)), F.lit(0)), F.count_distinct(F.nullif(F.col(c), F.lit("")))) for c in df.columns}
        wide = df.agg(*[v.alias(c) for c, v in each.items()])
        long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in df.columns])).alias("r"))
        names = ("row_count", "filled", "total_length", "distinct_values")
        parts.append(long.select(F.lit(table).alias("table_name"), "r.column_name", *[F.col(f"r.v.col{k}").alias(n) for k, n in enumerate(names, 1)]))
    return _union(parts)


def _load_sql(table: str) -> str:
    good, bad = f"(SELECT COUNT(*) FROM raw_{table})", f"(SELECT COUNT(*) FROM raw_{table} WHERE {KEYS[table]} LIKE '%{MALFORMED_END}')"
    return f"SELECT '{table}' AS table_name, {good} + {bad} AS lines_read, {bad} AS rejected, {good} AS rows_written, {good} AS rows_in_table, {bad} AS difference"


@register("load_reconciliation", with_ctes("\nUNION ALL ".join(map(_load_sql, TABLES))))
def load_reconciliation(w: Workload) -> DataFrame:
    """S4 + V23: the lines of the drops against the rows written and the rows in the files."""
    spark, folder = _drop(w)
    tables = scratch_table_path(spark, "loaded")
    return _union([sinks.load_csv(spark, os.path.join(folder, t), t, sinks.VersionedTable(spark, os.path.join(tables, t))) for t in TABLES])


STEPS = (("load", "raw"), ("replace", "clean"), ("swap", "unique"), ("restore", "clean"))


def _steps_sql(table: str) -> str:
    letter = table[0]
    rows = {"raw": f"raw_{table}", "clean": f"{letter}_clean", "unique": "c_final" if table == "customers" else f"{letter}_unique"}
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, CAST({k} AS BIGINT) AS seq, '{step}' AS step, (SELECT COUNT(*) FROM {rows[of]}) AS row_count, "
        f"(SELECT COUNT(*) FROM {rows[of]}) AS rows_read_back, {'TRUE' if k == len(STEPS) else 'FALSE'} AS is_current"
        for k, (step, of) in enumerate(STEPS, 1)
    )


@register("table_versions", with_ctes("\nUNION ALL ".join(map(_steps_sql, TABLES))))
def table_versions(w: Workload) -> DataFrame:
    """S3 + S5 + S8: each table loaded raw, replaced by its cleaned rows, swapped for its deduplicated ones, and
    restored; every commit with its rows as logged and as read back."""
    spark = w.raw["customers"].sparkSession
    folder = scratch_table_path(spark, "versions")
    clean = {"customers": w.customers_clean0, "subscriptions": w.subscriptions_clean0, "events": w.events_clean0}
    unique = {"customers": w.customers, "subscriptions": w.subscriptions, "events": w.events}
    parts = []
    for name in TABLES:
        table, fresh = (sinks.VersionedTable(spark, os.path.join(folder, name + suffix)) for suffix in ("", "-unique"))
        table.replace(w.raw[name], step="load")
        table.replace(clean[name])
        fresh.replace(unique[name])
        table.swap(fresh)
        table.restore(2)
        commits = table.log().collect()  # four rows
        for c in commits:
            held = spark.read.parquet(c["location"]).agg(F.count(F.lit(1)).alias("rows_read_back"))
            facts = [F.lit(name).alias("table_name"), F.lit(c["seq"]).cast("bigint").alias("seq"), F.lit(c["step"]).alias("step"), F.lit(c["row_count"]).cast("bigint").alias("row_count")]
            parts.append(held.select(*facts, "rows_read_back", F.lit(c["seq"] == len(commits)).alias("is_current")))
    return _union(parts)
