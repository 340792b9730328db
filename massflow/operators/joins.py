"""Joins that hold when one key has most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of one key that a join leaves in one task, if that is over a
#: thousandth of all rows.
HOT_ROWS = 10_000


def join_spread(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` (inner or left) for a written ``right`` of unique
    ``key`` whose column ``n`` counts the key's rows in ``left``, of ``total`` rows.

    A key of over ``HOT_ROWS`` rows and a thousandth of all is dealt to several
    tasks, with a copy of its row of ``right`` for each; there are at most 1,000
    such keys, and these are broadcast.  ``n`` is dropped."""
    bound = max(HOT_ROWS, total // 1000)
    hot = right.filter(F.col(n) > bound).select(F.col(key).alias("hot_key"), F.ceil(F.col(n) / bound).cast("long").alias("hot_parts"))
    if hot.isEmpty():
        return left.join(right.drop(n), key, how)
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) / bound)).cast("long")
    copies = right.withColumn("hot_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(n)
    marked = left.join(F.broadcast(hot), left[key] == F.col("hot_key"), "left")  # 1,000 rows at most
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *[c for c, kind in left.dtypes if kind in ("bigint", "int")]), F.col("hot_parts"))
    marked = marked.withColumn("hot_part", F.coalesce(spread, F.lit(0).cast("long"))).drop("hot_key", "hot_parts")
    return marked.join(copies, [key, "hot_part"], how).drop("hot_part")
