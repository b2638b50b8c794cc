"""Captured pages to raw offers, and the search links to capture next."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerloom.functions.dates import as_of_column, day_text
from offerloom.functions.urls import SEARCH_DEFAULTS, canonical_url, search_url
from offerloom.operators.dedupe import keep_first, row_hash
from offerloom.operators.html import detail_rows, listing_links
from offerloom.operators.sizing import broadcast_if_small
from offerloom.schemas import RAW_OFFERS
from offerloom.sources.versions import append_records, read_entries


def frontier(
    keywords: DataFrame, base_url: str, overrides: dict[str, str] | None = None
) -> DataFrame:
    """One search link per keyword row; the country does not enter the link."""
    return keywords.where("coalesce(role, '') <> ''").select(
        "role", "country", search_url(base_url, F.col("role"), overrides=overrides).alias("url")
    )


def found_links(
    pages: DataFrame, searches: DataFrame, max_jobs: int | None = None
) -> DataFrame:
    """``(role, link)`` seen on the newest readable capture of each search's listing.

    Captures with an error status, or none, count as not readable. Where the searches are
    few (their number is checked), they are broadcast and page bodies stay where they are.
    ``max_jobs`` keeps the first links per search in link order.
    """
    wanted = broadcast_if_small(searches.select("url", "role").distinct(), text_cols=("url", "role"))
    readable = pages.where(F.coalesce(F.col("status_code") < 400, F.lit(False)))
    newest = readable.select("url", "fetched_at").join(wanted.select("url").distinct(), "url", "left_semi")
    newest = newest.groupBy("url").agg(F.max("fetched_at").alias("newest")).withColumnRenamed("url", "own_url")
    listings = listing_links(readable.join(wanted, "url"), keep=("role", "fetched_at"))
    # Only narrow rows meet the dates.
    links = listings.join(
        newest, (F.col("url") == F.col("own_url")) & F.col("fetched_at").eqNullSafe(F.col("newest"))
    )
    links = links.select("role", "link").distinct()
    if max_jobs is None:
        return links
    window = Window.partitionBy("role").orderBy("link")
    return (
        links.withColumn("place", F.row_number().over(window))
        .where(F.col("place") <= max_jobs)
        .drop("place")
    )


def crawl(
    pages: DataFrame,
    searches: DataFrame,
    as_of: datetime | str,
    max_jobs: int | None = None,
) -> DataFrame:
    """Raw offers of all searches whose pages were captured; failed pages give no row.

    Detail pages are parsed where they are scanned, so extracted fields are
    shuffled and not markup. The newest readable capture of a link counts.
    """
    links = found_links(pages, searches, max_jobs)
    good = pages.where(F.coalesce(F.col("status_code") < 400, F.lit(False)))
    parsed = detail_rows(good, as_of, keep=("fetched_at",))
    details = parsed.withColumn("link", canonical_url(F.col("url"))).drop("url")
    newest = [F.desc_nulls_last("fetched_at"), row_hash(details)]
    rows = keep_first(details, ["link"], newest).join(links, "link").withColumns(
        {
            "query_keyword": F.col("role"),
            "country": F.lit(SEARCH_DEFAULTS["location"]),
            "apply_link": F.lit(None).cast("string"),
            "publication_date": day_text(F.col("publication_date")),
            "scraping_date": day_text(as_of_column(as_of)),
        }
    )
    return rows.select(*RAW_OFFERS.fieldNames())


def store_crawl(rows: DataFrame, root: str, day: date) -> int:
    """Add a day's raw offers to the versioned table at ``root``; a rerun replaces the day."""
    return append_records(rows.select(*RAW_OFFERS.fieldNames()), root, day.isoformat())


def stored_offers(spark: SparkSession, root: str) -> DataFrame:
    """Raw offers of all crawls so far, as of the newest version."""
    return read_entries(spark, root, RAW_OFFERS)
