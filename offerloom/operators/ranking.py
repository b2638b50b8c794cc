"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.session import cut_lineage


def row_number_in_groups(
    df: DataFrame, group: str, order: Sequence[Column], name: str
) -> DataFrame:
    """Number the rows of each group from 1, in an order without ties.

    ``row_number`` would sort a whole group in one task. Here the table is sorted
    by ranges over all tasks, so a large group spans several of them. Each task's
    share of a group is counted, and the shares before it give its offset. The
    sorted table is written to the shared folder, because ranges are sampled and
    must not differ between the count and the numbering.
    """
    ordered = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order)
    placed = cut_lineage(ordered.withColumn("__id", F.monotonically_increasing_id()))
    # The id holds the partition in its upper bits and the row's place in the lower 33.
    placed = placed.withColumn("__part", F.shiftright("__id", 33))
    shares = placed.groupBy(group, "__part").agg(
        F.min("__id").alias("__first"), F.count("*").alias("__n")
    )
    # At most one row per group and task.
    earlier = (
        Window.partitionBy(group)
        .orderBy("__part")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    offsets = shares.select(
        group,
        "__part",
        "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    number = F.col("__id") - F.col("__first") + F.col("__before") + 1
    return (
        placed.join(
            offsets.withColumnsRenamed({group: "__group", "__part": "__own_part"}),
            F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__own_part")),
        )
        .withColumn(name, number)
        .drop("__id", "__part", "__own_part", "__group", "__first", "__before")
    )
