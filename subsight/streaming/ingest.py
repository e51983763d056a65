"""Incremental landing of raw CSV drops into the staging tables (S1 + S3 as a stream).

The stream's rows are the files that appear in a landing folder. Each micro-batch reads its files as
the batch reader does: by the names in each file's own header, malformed lines kept apart. It writes
the folder ``batch=<number>`` of the staging table and of the table's rejects, replacing what an
interrupted run of the same batch left there. The streaming checkpoint records which files were
taken, so each file lands exactly once even if the job is restarted or an executor is lost.
``availableNow`` processes whatever is there and stops, so the same code serves a scheduled batch
and a long-running stream (drop ``available_now`` for a continuous trigger).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import staging
from ..sources.schemas import STAGING


FILES = "path string, modificationTime timestamp, length long, content binary"


def rejects_path(out_path: str) -> str:
    return f"{out_path.rstrip('/')}-rejects"


def land_csv(
    spark: SparkSession,
    landing_dir: str,
    table: str,
    out_path: str,
    checkpoint_location: str,
    available_now: bool = True,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Land the files of ``landing_dir`` in ``out_path`` and their malformed lines in ``rejects_path(out_path)``."""

    def land(files: DataFrame, batch_id: int) -> None:
        paths = [staging.literal_path(r["path"]) for r in files.collect()]  # at most max_files_per_trigger
        if not paths:
            return
        lines = staging.scan_csv(files.sparkSession, paths, table)
        good, bad = F.col(staging.CORRUPT).isNull(), F.col(staging.CORRUPT).isNotNull()
        batch = f"batch={batch_id:012d}"
        lines.where(good).drop(staging.CORRUPT).write.mode("overwrite").parquet(os.path.join(out_path, batch))
        lines.where(bad).withColumnRenamed(staging.CORRUPT, "line").write.mode("overwrite").parquet(os.path.join(rejects_path(out_path), batch))

    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files_per_trigger).load(landing_dir)
    writer = files.select("path").writeStream.foreachBatch(land).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def land_all(spark: SparkSession, landing_root: str, out_root: str, checkpoint_root: str) -> None:
    """Land ``landing_root/{customers,subscriptions,events}/*.csv`` into ``out_root/<table>``."""
    queries = [
        land_csv(
            spark,
            os.path.join(landing_root, t),
            t,
            os.path.join(out_root, t),
            os.path.join(checkpoint_root, t),
        )
        for t in STAGING
    ]
    for q in queries:
        q.awaitTermination()
