"""Writing and reading result tables.

Parquet replaces the workload's database tables. A ``VersionedTable`` is the replace-mode load, the
create-table-as-select and the drop / rename swap: readers see the old rows or the new ones, never
none or half of them. A folder of check tables plus a summary table replaces the multi-sheet workbook.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from . import staging


class TableConflict(RuntimeError):
    """Another writer committed first."""


class IncompleteWrite(RuntimeError):
    """The files hold another number of rows than the job wrote."""


class VersionedTable:
    """A table whose rows are replaced as a whole, by one small write at the end.

    ``path/data/<version>`` holds the rows of one version each; ``path/log`` has a row for each commit: its
    number, where the rows lie, how many there are, and what was done. The commit with the highest
    number is the table. Rows are written first, to a folder of their own; only when the files hold
    as many rows as the job saw pass does a commit name them. A write that fails leaves the table as
    it was, whatever it left behind in ``data``. Where two writers take the same number, the one whose
    location sorts first has it, and the other is told.
    """

    LOG = "seq long, location string, row_count long, step string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """The commits that count: one for each number."""
        try:
            rows = self.spark.read.schema(self.LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.LOG)
        first = F.min(F.struct("location", "row_count", "step")).alias("c")
        return rows.groupBy("seq").agg(first).select("seq", "c.*")

    def current(self) -> Row | None:
        return self.log().orderBy(F.desc("seq")).first()

    def read(self) -> DataFrame:
        """The rows of the last commit."""
        last = self.current()
        if last is None:
            raise ValueError(f"{self.path} has no version")
        return self.spark.read.parquet(last["location"])

    def replace(self, df: DataFrame, partition_by: list[str] | None = None, step: str = "replace") -> DataFrame:
        """S3: ``df`` becomes the table."""
        location = f"{self.path}/data/{uuid.uuid4().hex}"
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("row_count")).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(location)
        written, held = seen.get["row_count"], self.spark.read.parquet(location).count()
        if written != held:
            raise IncompleteWrite(f"{location}: {written} rows written, {held} in the files")
        return self._commit(location, held, step)

    def swap(self, other: VersionedTable) -> DataFrame:
        """The rows of ``other`` become the table's (create as, drop, rename); no row is moved."""
        return self._again(other.current(), "swap")

    def restore(self, seq: int) -> DataFrame:
        """The table as commit ``seq`` left it, as a new commit."""
        return self._again(self.log().where(F.col("seq") == seq).first(), "restore")

    def _again(self, commit: Row | None, step: str) -> DataFrame:
        if commit is None:
            raise ValueError(f"no such version for {self.path}")
        return self._commit(commit["location"], commit["row_count"], step)

    def _commit(self, location: str, row_count: int, step: str) -> DataFrame:
        last = self.current()
        seq = 1 if last is None else last["seq"] + 1
        row = self.spark.createDataFrame([(seq, location, row_count, step)], self.LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        kept = self.log().where(F.col("seq") == seq).first()
        if kept["location"] != location:
            raise TableConflict(f"{self.path}: commit {seq} is another writer's")
        return self.spark.read.parquet(location)


LOAD_REPORT = "table_name string, lines_read long, rejected long, rows_written long, rows_in_table long, difference long"


def load_csv(spark: SparkSession, path: str | list[str], table: str, target: VersionedTable) -> DataFrame:
    """S3 + S4 + V23: replace ``target`` with the CSV under ``path``, and what became of its lines, as one row.

    Lines are counted where they are read, rows where they are written, and once more in the files.
    ``difference`` is what the table lacks of the lines; malformed lines are ``rejected``.
    """
    seen = Observation()
    bad = F.col(staging.CORRUPT).isNotNull()
    lines = staging.scan_csv(spark, path, table).observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("rejected"))
    target.replace(lines.where(~bad).drop(staging.CORRUPT), step="load")
    read, written = seen.get, target.current()["row_count"]
    held = target.read().count()
    return spark.createDataFrame([(table, read["lines"], read["rejected"], written, held, read["lines"] - held)], LOAD_REPORT)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, **options: str) -> None:
    """``df`` appended to a CSV folder with headers, columns in the order of ``columns``, text kept as it is."""
    own = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"} | options
    df.select(*(columns or df.columns)).write.mode("append").options(**own).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` over a folder that nobody reads meanwhile, and continue from the files (see ``VersionedTable``)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return read_table(df.sparkSession, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder of ``write_table`` back."""
    return spark.read.parquet(path)


def preview(df: DataFrame, key: str | list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``key`` (a deterministic preview; the limit is the feature)."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*keys).limit(n)


def write_checks(checks: dict[str, DataFrame], folder: str) -> DataFrame:
    """One parquet table per check (empty ones too) and a ``check_summary`` table of row counts.

    Counts are read from the written tables, so every check runs exactly once.
    """
    spark = next(iter(checks.values())).sparkSession
    parts = []
    for name, df in checks.items():
        written = write_table(df, os.path.join(folder, name))
        parts.append(written.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check_name"), "rows"))
    summary = parts[0]
    for p in parts[1:]:
        summary = summary.unionByName(p)
    write_table(summary.coalesce(1), os.path.join(folder, "check_summary"))
    return read_table(spark, os.path.join(folder, "check_summary"))
