"""Dates: parsing, recency and relative phrases. No function reads a clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit words in test order, with their length in hours or days.
UNIT_WORDS = (
    (("hora", "hour"), "hour", 1),
    (("día", "day"), "day", 1),
    (("semana", "week"), "day", 7),
    (("mes", "month"), "day", 30),
    (("minuto", "minute"), "minute", 1),
    (("año", "year"), "day", 365),
)
# Larger amounts would leave the calendar (year 1); they count as unreadable.
_LIMIT = {"minute": 900_000_000, "hour": 15_000_000, "day": 700_000}


def as_of_column(as_of: datetime | str | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def parse_timestamp(text: Column, strict: bool = False) -> Column:
    """Text to timestamp; a bad value fails when strict and gives null otherwise."""
    return text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")


def day_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def is_recent(moment: Column, as_of: datetime | str | Column, days: int = 7) -> Column:
    """At most ``days`` before ``as_of``, compared to the microsecond."""
    return moment.cast("timestamp_ntz") >= as_of_column(as_of) - F.expr(f"INTERVAL {days} DAYS")


def relative_date(phrase: Column, as_of: datetime | str | Column) -> Column:
    """Date meant by ``hace 3 días`` or ``3 days ago``; anything else is the day of ``as_of``."""
    now = as_of_column(as_of)
    words = F.split(F.trim(F.regexp_replace(F.lower(phrase), r"(?U)\s+", " ")), " ")
    # One-element arrays serve as local names: a phrase is taken apart once.
    amounts = F.transform(F.array(words), _amount)
    moved = F.transform(amounts, lambda p: _moved_day(now, p["value"], p["unit"]))
    return F.coalesce(F.get(moved, F.lit(0)), now.cast("date"))


def _amount(words: Column) -> Column:
    """Value and unit of a phrase: ``hace <value> <unit>`` or ``<value> <unit> ago``."""
    first = (
        F.when(F.size(words) < 3, None)
        .when(F.array_contains(words, "hace"), F.lit(1))
        .when(F.array_contains(words, "ago"), F.lit(0))
    )
    value = F.get(words, first).try_cast("bigint")
    return F.struct(value.alias("value"), F.get(words, first + 1).alias("unit"))


def _moved_day(now: Column, value: Column, unit: Column) -> Column:
    result = None
    for names, kind, factor in UNIT_WORDS:
        hit = F.lit(False)
        for name in names:
            hit = hit | F.contains(unit, F.lit(name))
        span = F.when(F.abs(value) <= _LIMIT[kind] // factor, value * factor).cast("int")
        if kind == "day":
            moved = F.date_sub(now.cast("date"), span)
        elif kind == "hour":
            moved = (now - F.make_dt_interval(F.lit(0), span)).cast("date")
        else:
            moved = (now - F.make_dt_interval(F.lit(0), F.lit(0), span)).cast("date")
        result = F.when(hit, moved) if result is None else result.when(hit, moved)
    return result
