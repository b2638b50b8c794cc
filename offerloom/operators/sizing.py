"""Size checks that stand before every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def fits(df: DataFrame, max_rows: int, max_bytes: int, text_cols: tuple[str, ...] = ()) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` of text.

    Counts are combined in the map tasks, so a table that turns out to be large
    costs one narrow pass and nothing on the driver.
    """
    size = F.lit(0).cast("bigint")
    for name in text_cols:
        size = size + F.coalesce(F.octet_length(name), F.lit(0))
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def broadcast_if_small(
    df: DataFrame,
    max_rows: int = 1_000_000,
    max_bytes: int = 64 << 20,
    text_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Broadcast hint behind a size check; otherwise the join strategy is left to Spark."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes, text_cols) else df


def rows_if_small(df: DataFrame, max_rows: int) -> list[Row] | None:
    """All rows when there are at most ``max_rows``, else ``None``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
