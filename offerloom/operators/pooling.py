"""Mean-pooling of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool_long(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean per key as ``(key, dim, mean)``, dimensions from 0.

    Sums are combined in the map tasks, so a group of any size sends one row per
    task and dimension.
    """
    exploded = df.select(key, F.posexplode(vector).alias("dim", "x"))
    return exploded.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def pool(df: DataFrame, key: str, vector: str, out_col: str = "vector") -> DataFrame:
    """Element-wise mean per key as one array; groups may be of any size."""
    long = pool_long(df, key, vector)
    # One entry per dimension: the array is as long as a vector, whatever the group.
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    return long.groupBy(key).agg(F.transform(ordered, lambda s: s["mean"]).alias(out_col))
