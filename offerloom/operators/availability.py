"""Availability of offers, judged on captured responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.urls import strip_query
from offerloom.operators.filters import known_available, not_known_unavailable


def still_available(
    job_id: Column, link: Column, status_code: Column, body: Column, tags: Sequence[str]
) -> Column:
    """False without an id or link, on 404, or when a tag is in the body; else true.

    A missing response counts as a failed request, and those leave an offer alive.
    """
    tagged = F.lit(False)
    for tag in tags:
        tagged = tagged | F.contains(body, F.lit(tag))
    unusable = (F.coalesce(job_id, F.lit("")) == "") | (F.coalesce(link, F.lit("")) == "")
    return (
        F.when(unusable, F.lit(False))
        .when(F.coalesce(status_code == 404, F.lit(False)), F.lit(False))
        .otherwise(~F.coalesce(tagged, F.lit(False)))
    )


def latest_verdicts(pages: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Newest capture per link as ``(link, gone)``, without its body.

    The body is reduced to a flag in the scan, so only narrow rows are shuffled.
    """
    tagged = F.lit(False)
    for tag in tags:
        tagged = tagged | F.contains("body", F.lit(tag))
    gone = F.coalesce(F.col("status_code") == 404, F.lit(False)) | F.coalesce(tagged, F.lit(False))
    narrow = pages.select(strip_query(F.col("url")).alias("link"), "fetched_at", gone.alias("gone"))
    newest = F.struct(F.col("fetched_at"), F.col("gone"))
    return narrow.groupBy("link").agg(F.max_by("gone", newest).alias("gone"))


def check_offers(offers: DataFrame, pages: DataFrame, tags: Sequence[str]) -> DataFrame:
    """``(job_id, available)`` for every offer not known to be unavailable."""
    unusable = (F.coalesce("job_id", F.lit("")) == "") | (F.coalesce("link", F.lit("")) == "")
    # Rows without a link have nothing to look up: a key made from their id spreads them
    # over the tasks, the same way on every attempt.
    spread = F.concat(F.lit("\0"), F.xxhash64("job_id").cast("string"))
    key = F.when(unusable, spread).otherwise(F.col("link"))
    due = offers.where(not_known_unavailable(F.col("available"))).select(
        "job_id", unusable.alias("unusable"), key.alias("link")
    )
    verdicts = latest_verdicts(pages, tags)
    return due.join(verdicts, "link", "left").select(
        "job_id",
        (~F.col("unusable") & ~F.coalesce("gone", F.lit(False))).alias("available"),
    )


def with_check_results(offers: DataFrame, checks: DataFrame) -> DataFrame:
    """Offers with the checked state: known unavailable stays so, the rest takes its check."""
    # A repeated id keeps one verdict: with ids unique upstream there is nothing to choose.
    verdicts = checks.groupBy("job_id").agg(F.max("available").alias("checked"))
    state = F.when(not_known_unavailable(F.col("available")), F.col("checked")).otherwise(
        F.lit(False)
    )
    return (
        offers.join(verdicts, "job_id", "left").withColumn("available", state).drop("checked")
    )


def keep_available(offers: DataFrame, checks: DataFrame) -> DataFrame:
    """Offers whose state after the check is available; unchecked ones are dropped."""
    return with_check_results(offers, checks).where(known_available(F.col("available")))


def expire_by_pages(offers: DataFrame, pages: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Check and update in one step: the same rows as ``keep_available`` over ``check_offers``.

    Only the links found gone take part in the join, so wide offer rows move at
    most once, and not at all when the gone links are few enough to broadcast.
    """
    usable = (F.coalesce("job_id", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != "")
    gone = latest_verdicts(pages, tags).where("gone").select("link")
    return (
        offers.where(not_known_unavailable(F.col("available")) & usable)
        .join(gone, "link", "left_anti")
        .withColumn("available", F.lit(True))
        .select(*offers.columns)
    )
