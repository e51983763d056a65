"""Small helpers shared by the operators: table access, lineage cuts, text columns in Arrow."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from subsight.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again with its schema."""
    return cut_lineage(df, f"llm-{name}")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding it to ``str``."""
    return column.cast(pa.binary()).to_pylist()


def spare_name(taken: list[str], base: str) -> str:
    """``base``, or ``base_2``, ``base_3``, ... : the first that is not a column already (case-blind)."""
    names = {c.lower() for c in taken}
    name, n = base, 1
    while name.lower() in names:
        n += 1
        name = f"{base}_{n}"
    return name


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives ``value`` inside tasks; it is broadcast once, so its size must be bounded."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on in this session: texts are long, and a batch of the
    usual 10,000 rows is held by the executor, by the socket and by the worker at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def lean_memory() -> None:
    """In a task: Arrow gives buffers back to the system when they are dropped, and does not keep them."""
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """In a task: freed memory goes back to the system, if the C library can do that. Spark keeps a worker for later tasks, with all it holds."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
