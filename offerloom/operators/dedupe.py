"""Keep-first deduplication and new-wins upserts with a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RN = "__rank_in_key"
SOURCE_RANK = "source_rank"


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    long_keys: bool = False,
) -> DataFrame:
    """One row per key, the first in ``order``; null keys count as equal.

    ``row_number() = 1`` keeps one row per key in every map task before the
    shuffle, so a key that holds a third of the table still sends one row per task.
    ``long_keys`` puts a hash in front of long text keys: sorting then compares
    eight bytes first and the text only where the hashes agree.
    """
    partition = [F.col(k) for k in keys]
    if long_keys:
        partition = [F.xxhash64(*keys), *partition]
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(window)).where(F.col(_RN) == 1).drop(_RN)


def keep_first_in_sequence(
    df: DataFrame,
    steps: Sequence[Sequence[str]],
    order: Sequence[Column],
    long_keys: bool = False,
) -> DataFrame:
    """Deduplicate on each key set in turn, each time among the survivors."""
    for keys in steps:
        df = keep_first(df, keys, order, long_keys)
    return df


def union_new_first(new: DataFrame, old: DataFrame) -> DataFrame:
    """Union by name with a rank that puts new rows before old ones."""
    ranked_new = new.withColumn(SOURCE_RANK, F.lit(0))
    ranked_old = old.withColumn(SOURCE_RANK, F.lit(1))
    return ranked_new.unionByName(ranked_old, allowMissingColumns=True)


def upsert(
    new: DataFrame,
    old: DataFrame,
    keys: Sequence[str],
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """Merge two tables; a new row replaces the old row with its key."""
    both = union_new_first(new, old)
    return keep_first(both, keys, [F.col(SOURCE_RANK), *tie_break]).drop(SOURCE_RANK)


def distinct_at_first_position(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values, each with the smallest position it had."""
    return df.groupBy(value).agg(F.min(pos).alias(pos)).select(pos, value)


def row_hash(df: DataFrame) -> Column:
    """Last tie-break of a total order: equal only for equal rows."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
