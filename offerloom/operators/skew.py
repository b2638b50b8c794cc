"""Equi-joins whose hot keys are dealt over several tasks.

A key that many rows of the left side hold is cut into rows of a grid, one that many rows of
the right side hold into columns. A left row belongs to one grid row and is repeated for each
column, a right row belongs to one column and is repeated for each grid row, so that every
pair of rows meets in exactly one cell and no cell is larger than stated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many keys, the hottest, are cut. They travel to every task as numbers, some 16 bytes each;
#: a key that is left whole holds less than one part in so many of all pairs.
MOST_CUT = 200_000
#: Pairs that one cell may give, and rows of one side that it may hold.
CELL_PAIRS, CELL_ROWS = 16_000_000, 1_000_000


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    parts = [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys]
    return reduce(lambda a, b: a & b, parts)


def _hash(keys: Sequence[str]) -> Column:
    """Number of a key. Keys that share one share their cuts, which is harmless."""
    return F.xxhash64(*keys)


def key_sizes(side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, n)``, combined in the map tasks."""
    return side.groupBy(*keys).agg(F.count("*").alias("n"))


def _hottest(cuts: DataFrame) -> DataFrame:
    cut = cuts.where("cut_rows > 1 or cut_columns > 1")
    return cut.orderBy(F.desc("heat"), "cut_key").limit(MOST_CUT).select("cut_key", "cut_rows", "cut_columns")


def grid_cuts(
    left_sizes: DataFrame, right_sizes: DataFrame, keys: Sequence[str],
    cell_pairs: int = CELL_PAIRS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(cut_key, cut_rows, cut_columns)`` of the keys to cut, from ``(keys, n)`` of both sides.

    Of the grids whose cells give at most ``cell_pairs`` pairs the one that repeats fewest rows
    is taken: the smaller side stays whole up to the root of ``cell_pairs`` rows, beyond it both
    sides are cut to that many.
    """
    left = left_sizes.groupBy(_hash(keys).alias("cut_key")).agg(F.sum("n").alias("left_n"))
    right = right_sizes.groupBy(_hash(keys).alias("right_key")).agg(F.sum("n").alias("right_n"))
    both = left.join(right, F.col("cut_key") == F.col("right_key"))
    small, large = F.least("left_n", "right_n"), F.greatest("left_n", "right_n")
    part = F.least(small, F.lit(max(1, int(cell_pairs**0.5))), F.lit(cell_rows))
    other = F.greatest(F.lit(1), F.least(F.floor(F.lit(cell_pairs) / part), F.lit(cell_rows)))
    few, many = F.ceil(small / part).cast("int"), F.ceil(large / other).cast("int")
    on_left = F.col("left_n") >= F.col("right_n")
    return _hottest(
        both.select(
            "cut_key", F.when(on_left, many).otherwise(few).alias("cut_rows"),
            F.when(on_left, few).otherwise(many).alias("cut_columns"),
            (F.col("left_n").cast("double") * F.col("right_n")).alias("heat"),
        )
    )


def _in_cells(
    side: DataFrame, cuts: DataFrame, keys: Sequence[str], spread_by: str, own: str, other: str
) -> DataFrame:
    """``side`` with ``cell_{own}``, by a hash of ``spread_by``, repeated for each ``cell_{other}``."""
    named = side.join(F.broadcast(cuts), _hash(keys) == F.col("cut_key"), "left")
    slot = F.pmod(F.xxhash64(spread_by), F.col(f"cut_{own}")).cast("int")
    each = F.sequence(F.lit(0), F.coalesce(F.col(f"cut_{other}"), F.lit(1)) - 1)
    placed = named.withColumn(f"cell_{own}", F.coalesce(slot, F.lit(0))).withColumn(f"cell_{other}", F.explode(each))
    return placed.drop("cut_key", "cut_rows", "cut_columns")


def _cell_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cuts: DataFrame, left_by: str, right_by: str
) -> DataFrame:
    cells = ("cell_rows", "cell_columns")
    left = _in_cells(left, cuts, keys, left_by, "rows", "columns")
    right = _in_cells(right, cuts, keys, right_by, "columns", "rows")
    for name in (*keys, *cells):
        right = right.withColumnRenamed(name, f"other_{name}")
    same_cell = reduce(lambda a, b: a & b, [left[c] == right[f"other_{c}"] for c in cells])
    joined = left.join(right, _null_safe(left, right, keys, "other_") & same_cell, "inner")
    return joined.drop(*cells, *[f"other_{name}" for name in (*keys, *cells)])


def grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_by: str,
    right_by: str,
    cell_pairs: int = CELL_PAIRS,
    cell_rows: int = CELL_ROWS,
    sizes: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Inner join on ``keys``, nulls matching nulls, where either side or both may be skewed.

    ``left_by`` and ``right_by`` are the columns whose values spread the rows of a hot key. The
    result does not depend on ``cell_pairs`` and ``cell_rows``. ``sizes`` may give ``(keys, n)``
    of both sides where counting these themselves would be costly.
    """
    sizes = (key_sizes(left, keys), key_sizes(right, keys)) if sizes is None else sizes
    cuts = grid_cuts(*sizes, keys, cell_pairs, cell_rows)
    return _cell_join(left, right, keys, cuts, left_by, right_by)


def salted_join(
    big: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    rows_per_salt: int = CELL_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Inner join on ``keys``, nulls matching nulls, where only ``big`` is skewed.

    A key with more than ``rows_per_salt`` rows in ``big`` is cut into that many grid rows, and
    only its rows in ``other`` are repeated. ``sizes`` may give ``(keys, n)`` where counting
    ``big`` itself would be costly.
    """
    sizes = key_sizes(big, keys) if sizes is None else sizes
    counted = sizes.groupBy(_hash(keys).alias("cut_key")).agg(F.sum("n").alias("heat"))
    rows = F.ceil(F.col("heat") / rows_per_salt).cast("int").alias("cut_rows")
    cuts = _hottest(counted.select("cut_key", rows, F.lit(1).alias("cut_columns"), "heat"))
    return _cell_join(big, other, keys, cuts, spread_by, spread_by if spread_by in other.columns else keys[0])
