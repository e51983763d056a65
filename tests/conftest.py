import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from subsight.session import ADAPTIVE_CONF, BASE_CONF

    ckpt = tempfile.mkdtemp(prefix="subsight-test-ckpt-")
    b = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", ckpt)
    )
    for k, v in {**BASE_CONF, **ADAPTIVE_CONF}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, order=None):
    """Collect as a list of dicts, sorted for order-free comparison."""
    out = [r.asDict() for r in df.collect()]
    key = order or (lambda d: tuple(str(d[k]) for k in sorted(d)))
    return sorted(out, key=key)
