"""Matches joined back to their offers, and the report lines of each seeker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.functions.report import HEADER_LINES, report_row
from offerloom.operators.ranking import row_number_in_groups

READING_ORDER = ["section", "newest", "best", "job_id"]


def seeker_matches(matches: DataFrame, offers: DataFrame) -> DataFrame:
    """Every match with its offer's title, link and date; matches without an offer drop out."""
    shown = offers.select(
        "job_id", F.col("vacancy_name").alias("job_offer"), "link", "publication_date"
    )
    scored = matches.where("score is not null").select("user_id", "job_id", "score")
    return scored.join(shown, "job_id")


def newest_then_best(rows: DataFrame) -> DataFrame:
    """Order per user: date descending, then score descending, then id."""
    return rows.orderBy(
        "user_id", F.desc_nulls_last("publication_date"), F.desc("score"), "job_id"
    )


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """Position of each match in its seeker's list, whatever the list's length."""
    order = [F.desc_nulls_last("publication_date"), F.desc("score"), F.col("job_id")]
    return row_number_in_groups(rows, "user_id", order, name)


def report_lines(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Report lines of the given users with the columns of ``READING_ORDER``.

    Every user has the header lines; users without matches have only those.
    """
    wanted = users.select("user_id").distinct()
    header = F.array(
        *[F.struct(F.lit(i).alias("section"), F.lit(h).alias("line")) for i, h in enumerate(HEADER_LINES)]
    )
    tops = wanted.select(
        "user_id",
        F.inline(header),
    ).select(
        "user_id",
        "section",
        F.lit(0).alias("newest"),
        F.lit(0.0).alias("best"),
        F.lit("").alias("job_id"),
        "line",
    )
    day = F.datediff("publication_date", F.lit("1970-01-01").cast("date"))
    body = rows.join(wanted, "user_id", "left_semi").select(
        "user_id",
        F.lit(len(HEADER_LINES)).alias("section"),
        F.coalesce(-day, F.lit(10**6)).alias("newest"),
        (-F.col("score")).alias("best"),
        "job_id",
        report_row(
            F.col("job_offer"), F.col("link"), F.col("score"), F.col("publication_date")
        ).alias("line"),
    )
    return tops.unionByName(body)
