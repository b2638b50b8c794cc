"""Markdown pieces of a seeker's report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three lines every report starts with.
HEADER_LINES = (
    "# 🚀 Latest Job Offers Recommendations!",
    "| 🗃️ **Job offer** | 🌡️**Score** | 🗓️ **publication_date** |",
    "|---|---|---|",
)


def plain_title(title: Column) -> Column:
    """Title without the characters that would break a link or a table cell."""
    return F.translate(title, "[]()|", "")


def percent_text(score: Column) -> Column:
    """Score in percent with two decimals, rounded from the exact binary value.

    Java formats the shortest decimal text of a double, so 72.345 would round by
    its text. Here the double is split in two halves whose products with 100 are
    exact, and the sign of their distance to the midpoint decides; a true tie goes
    to the even digit.
    """
    value = F.abs(score * 100)
    scaled = value * F.lit(float(2**27 + 1))
    high = scaled - (scaled - value)
    low = value - high
    down = F.floor(high * 100 + low * 100).cast("bigint")
    above = (high * 100 - down.cast("double") - F.lit(0.5)) + low * 100
    up = (above > 0) | ((above == 0) & (down % 2 == 1))
    cents = down + F.when(up, F.lit(1)).otherwise(F.lit(0))
    whole = F.floor(cents / 100).cast("bigint")
    return F.concat(
        F.when(score < 0, F.lit("-")).otherwise(F.lit("")),
        whole.cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
        F.lit("%"),
    )


def report_row(title: Column, link: Column, score: Column, published: Column) -> Column:
    return F.concat(
        F.lit("| ["),
        F.coalesce(plain_title(title), F.lit("")),
        F.lit("]("),
        F.coalesce(link, F.lit("")),
        F.lit(") | "),
        percent_text(F.coalesce(score, F.lit(0.0))),
        F.lit(" | "),
        F.coalesce(published.cast("string"), F.lit("")),
        F.lit(" |"),
    )
