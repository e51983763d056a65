"""Turn (row, count) back into ``count`` copies of the row, spread over many tasks.

Used wherever a result must list *every* copy of a repeated row: the rows are
first collapsed to (row, count) by a partial-then-final hash aggregate (cheap,
skew-proof), and only the offending groups are re-expanded. A count is cut into pieces, these into
smaller ones, and so on, each time into at most ``chunk`` for any count below chunk ** 4, and the
pieces are spread over the shuffle partitions in between. No row ever holds a list longer than
``chunk``, and no task regenerates more than the chunks dealt to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_CHUNK = 8192
LEVELS = 3


def expand_counts(df: DataFrame, count_col: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    keys = [c for c in df.columns if c != count_col]
    # An explicit partition count: adaptive execution never coalesces it, so the
    # pieces (few, small rows) stay spread even though their shuffle is tiny.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.select(*[F.col(k) for k in keys], F.col(count_col).cast("long").alias("_n"), F.lit(0).cast("long").alias("_piece")).filter("_n > 0")
    for level in range(LEVELS, 0, -1):
        size = F.lit(chunk**level).cast("long")
        pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / size).cast("long")))
        cut = held.select(*keys, "_n", "_piece", pieces.alias("_p"))
        rest = F.least(size, F.col("_n") - F.col("_p") * size)
        held = cut.select(*keys, rest.alias("_n"), F.xxhash64("_piece", "_p").alias("_piece"))
        if level <= 2:
            held = held.repartition(width, *[F.col(k) for k in keys], F.col("_piece"))
    return held.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i")).drop("_i")
