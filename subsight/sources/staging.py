"""Landing the three raw tables (S1, S2) and the typed read of them.

Raw files are read with the declared all-string staging schema (no inference:
a country code such as ``NA`` stays text, only an empty field is NULL). The
*typed* view is what a profiling read sees: empty text -> NULL, dates and the
price parsed, nothing trimmed or filled.
"""

from __future__ import annotations

import os
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .schemas import STAGING

DATE_COLUMNS = {
    "customers": ("signup_date",),
    "subscriptions": ("start_date", "end_date"),
    "events": ("event_date",),
}
MONEY_COLUMNS = {"subscriptions": ("monthly_price",)}


CORRUPT = "_corrupt_record"
#: Headers read at a time (each is a job that reads the first line of one file).
HEADER_READERS = 16


def csv_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The non-empty files under ``path``, listed by Spark; their contents are not read."""
    found = spark.read.format("binaryFile").load(path).where("length > 0").select("path").collect()
    return sorted(r["path"] for r in found)


def literal_path(path: str) -> str:
    """``path`` as a pattern that fits only itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def csv_layouts(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files under ``path`` by the column names of their headers, in order."""
    files = csv_files(spark, path)
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = list(pool.map(lambda f: tuple(spark.read.option("header", True).csv(literal_path(f)).columns), files))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers, strict=True):
        layouts.setdefault(header, []).append(file)
    return layouts


def scan_csv(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """The columns of ``table`` by the names in each file's own header, all text, and the text of malformed lines.

    Files may differ in the order of their columns and in what else they have; a missing column is
    an error. Files of one header are one scan. ``_corrupt_record`` is NULL for a line that has as
    many fields as its header. Empty files have no rows.
    """
    names = STAGING[table].fieldNames()
    empty = T.StructType([*STAGING[table].fields, T.StructField(CORRUPT, T.StringType())])
    out = None
    for header, files in csv_layouts(spark, path).items():
        missing = [n for n in names if n not in header]
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
        rows = (
            spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]]))
            .option("header", True)
            .option("enforceSchema", False)  # a header that changed since is an error
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", False)  # else the fields of a line are not counted
            .option("emptyValue", "")
            .csv([literal_path(f) for f in files])
            .select(*names, CORRUPT)
        )
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], empty) if out is None else out


def read_staging_csv(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """The well-formed rows of a headered CSV, read by column name; ``csv_rejects`` has the others."""
    return scan_csv(spark, path, table).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def csv_rejects(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """The malformed lines of a CSV: what could be read of them, and ``line``, their text."""
    return scan_csv(spark, path, table).where(F.col(CORRUPT).isNotNull()).withColumnRenamed(CORRUPT, "line")


def read_staging_dir(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The trio from ``folder/{customers,subscriptions,events}.csv``."""
    return {t: read_staging_csv(spark, os.path.join(folder, f"{t}.csv"), t) for t in STAGING}


def typed(raw: DataFrame, table: str) -> DataFrame:
    """The typed read: empty -> NULL, date and money columns parsed, text kept as is."""
    dates = DATE_COLUMNS.get(table, ())
    money = MONEY_COLUMNS.get(table, ())
    out = []
    for c in raw.columns:
        if c in dates:
            out.append(S.parse_date_or_time(c).alias(c))
        elif c in money:
            out.append(S.parse_money(c).alias(c))
        else:
            out.append(F.nullif(F.col(c), F.lit("")).alias(c))
    return raw.select(*out)
