"""Row filters with stated null behaviour."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.dates import as_of_column, is_recent


def not_listed(col: Column, excluded: Sequence[str]) -> Column:
    """Not in the list; a null value is kept."""
    if not excluded:
        return F.lit(True)
    return ~F.coalesce(col.isin(list(excluded)), F.lit(False))


def not_known_unavailable(available: Column) -> Column:
    return F.coalesce(available, F.lit(True))


def known_available(available: Column) -> Column:
    return F.coalesce(available, F.lit(False))


def language_allowed(seeker_english: Column, offer_english: Column) -> Column:
    """A seeker without English sees only offers that are not in English."""
    return seeker_english | ~F.coalesce(offer_english, F.lit(False))


def recent(df: DataFrame, col: str, as_of: datetime | str, days: int) -> DataFrame:
    return df.where(is_recent(F.col(col), as_of, days))


def last_days(col: Column, as_of: datetime | str, days: int) -> Column:
    """Date strictly after the day ``days`` before ``as_of``."""
    return col > F.date_sub(as_of_column(as_of).cast("date"), days)


def exactly_days_ago(col: Column, as_of: datetime | str, days: int) -> Column:
    return col == F.date_sub(as_of_column(as_of).cast("date"), days)


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in one of ``cols``, or in any column."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def ids_missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``other`` lacks; repeated keys there are merged before the shuffle."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def ids_present_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``other`` has; repeated keys there are merged before the shuffle."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def first_rows(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows in a stated order; everything when ``n`` is ``None``."""
    return df if n is None else df.orderBy(*order).limit(n)
