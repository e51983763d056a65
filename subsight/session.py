"""SparkSession construction and the few session-level settings the jobs rely on.

Everything here is plain Spark configuration: adaptive query execution (runtime
re-planning, partition coalescing, skew-join splitting), a UTC session clock so
dates never shift, and the shared checkpoint folder used to cut lineage.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does three things we depend on at scale:
#  * coalesces the many small post-aggregation partitions (cells are few);
#  * splits a skewed join partition (one customer holding a third of the rows)
#    into several tasks for inner / left-outer / semi / anti joins;
#  * turns a shuffle join into a broadcast only when the *measured* runtime size
#    of one side is under the threshold - a checked size, never a guess.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    # No broadcast from plan-time estimates (they are blind to rows added by
    # explode and to skew): every implicit broadcast is decided by AQE on the
    # measured size of a finished shuffle stage. Explicit hints remain only for
    # sides of a proven size (TPC-H nation / region, fixed-size bucket tables).
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 128 MiB input splits keep a parquet task's working set well inside an
    # executor's memory; the shuffle width is sized per cluster below.
    "spark.sql.files.maxPartitionBytes": "128m",
    # Checkpoint files of DataFrames that are no longer referenced are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "subsight",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or fetch) a session with the adaptive settings above.

    ``shuffle_partitions`` is the *initial* shuffle width; AQE coalesces it at
    runtime, so on a cluster set it generously (a few x total cores) and let the
    measured partition sizes shrink it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf.update(ADAPTIVE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 256 << 20, floor: int = 200) -> int:
    """Initial shuffle width for an input of ``input_bytes``: about one partition per
    ``target_bytes`` of input, never below ``floor``. AQE then coalesces the
    (much smaller) post-aggregation shuffles; the first, widest shuffles keep
    partitions near the target so they fit in executor memory without spilling.
    Example: 100 TiB of input -> 409,600 partitions; pass it to ``build_session``.
    """
    return max(floor, -(-input_bytes // target_bytes))


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Single-JVM session for tests and the bench."""
    return build_session(
        master=f"local[{cores}]",
        shuffle_partitions=shuffle_partitions or cores,
        extra={"spark.driver.memory": "16g"},
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    filesystem every executor can reach). Only when it is unset - a local run or
    a test - do we pick a fresh scratch folder of our own.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: on a cluster it must name a folder every executor "
            "can reach (lineage cuts are written there); a machine-local folder would not be shared"
        )
    if not configured:
        global _LOCAL_CKPT
        if _LOCAL_CKPT is None:
            _LOCAL_CKPT = tempfile.mkdtemp(prefix="subsight-ckpt-")
        configured = _LOCAL_CKPT
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


_LOCAL_CKPT: str | None = None


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Unlike ``DataFrame.checkpoint`` (row-serialised blocks), the result is a
    columnar scan: later filters and projections are pushed into it, and a lost
    executor re-reads the files instead of recomputing the lineage.
    """
    path = scratch_table_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
