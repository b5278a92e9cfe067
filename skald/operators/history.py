"""Windows over a session's earlier rows that stay bounded when one session holds a large part of all rows.

Sessions of at most hot_rows rows take one window each. If a session is larger, rows are ordered by range partitioning, numbered through
per-partition counts, and cut into pieces that carry the last `back` rows of the piece before as context, so that each window stays within a piece.
Results are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..common import cut

HOT_ROWS = 200_000


def number_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds _n, the number of earlier rows of the same key; rows of one key may lie in many tasks."""
    ordered = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = cut(ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    runs = placed.groupBy(key, "_pid").agg(F.min("_mid").alias("_first"), F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(key).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select(F.col(key).alias("_k"), F.col("_pid").alias("_p"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = placed.join(runs, placed[key].eqNullSafe(runs["_k"]) & (placed["_pid"] == runs["_p"]))
    return joined.withColumn("_n", F.col("_mid") - F.col("_first") + F.col("_before")).drop("_pid", "_mid", "_first", "_before", "_k", "_p")


def with_history(df: DataFrame, key: str, order: list[str], back: int, add: Callable[[WindowSpec], dict[str, Column]], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds _n (number of earlier rows) and the columns that `add` makes from a window by key and order; they may look back `back` rows."""
    largest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if largest <= hot_rows:
        w = W.partitionBy(key).orderBy(*order)
        return df.withColumns({"_n": (F.row_number().over(w) - 1).cast("long"), **add(w)})
    size = max(hot_rows // 2, 2 * back)
    rows = number_rows(df, key, order)
    own = rows.withColumn("_piece", F.floor(F.col("_n") / size)).withColumn("_context", F.lit(False))
    tail = rows.filter(F.col("_n") % size >= size - back).withColumn("_piece", F.floor(F.col("_n") / size) + 1).withColumn("_context", F.lit(True))
    w = W.partitionBy(key, "_piece").orderBy("_n")
    return own.unionByName(tail).withColumns(add(w)).filter("not _context").drop("_piece", "_context")
