"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import staged

MAX_ROUNDS = 60


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.where(F.col("a") > F.col("b")).distinct()


def _print(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with an edge, ``root`` the smallest node reached.

    ``edges`` has long columns ``a`` and ``b``. Every round is written to the shared folder;
    the rounds grow with the logarithm of the longest chain. Only counts and checksums
    reach the driver. No edges give no rows.
    """
    now = staged(_downward(edges), "edges")
    seen = _print(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = now.union(now.select("b", "a").toDF("a", "b"))
        lows = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("of"), F.least("a", "low").alias("low")
        )
        large = both.where(F.col("b") > F.col("a")).join(lows, F.col("a") == F.col("of"))
        large = _downward(large.select(F.col("b").alias("a"), F.col("low").alias("b")))
        lows = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "of")
        small = large.join(lows, F.col("a") == F.col("of"))
        ends = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        now = staged(_downward(small.select(ends.alias("e")).select("e.a", "e.b")), "edges")
        last, seen = seen, _print(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())
