"""The whole run: crawl, offers, expiry, embeddings, matches, reports."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.config import EngineConfig
from offerloom.operators.availability import expire_by_pages
from offerloom.operators.embedding import ModelFactory
from offerloom.plans.crawl import crawl, frontier, store_crawl, stored_offers
from offerloom.plans.embed import embed_offers, embed_seekers
from offerloom.plans.match import recommend
from offerloom.plans.offers import build_offers, unusable_offers
from offerloom.plans.report import READING_ORDER, report_lines, seeker_matches
from offerloom.sources.records import read_records, read_skills, read_table, split_unreadable
from offerloom.sources.reports import write_reports
from offerloom.sources.snapshots import read_latest, replace_snapshot, write_snapshot


def _set_aside(config: EngineConfig, day: date, parts: dict[str, list[DataFrame]]) -> dict[str, int]:
    """Write ``(source, reason, record)`` of all parts as this day's quarantine; rows by reason."""
    each = [p.select(F.lit(s).alias("source"), "reason", "record") for s, ps in parts.items() for p in ps]
    rows = reduce(DataFrame.unionByName, each).persist()
    replace_snapshot(rows, config.quarantine or f"{config.offers.rstrip('/')}_quarantine", day)
    counts = rows.groupBy("source", "reason").count().collect()
    rows.unpersist()
    return {f"{r['source']}: {r['reason']}": r["count"] for r in counts}


def run(
    spark: SparkSession,
    config: EngineConfig,
    as_of: datetime,
    factory: ModelFactory,
    lines: bool = False,
) -> dict[str, int]:
    """Run all stages; each hands a dated table to the next.

    Where ``config.crawled`` names a table, the offers found on captured pages for
    ``config.keywords`` are stored there under their day, and all stored ones are raw offers.

    Unreadable records and unusable raw rows go to a dated quarantine table with their
    reasons (``config.quarantine``, or a folder beside the offers); their numbers are returned.
    A stage that is run again for the same day replaces its own snapshot, so a run
    that broke off can be repeated.
    """
    read = [
        read_records(spark, path, schema, lines, keep_corrupt=True).persist()
        for path, schema in ((config.seekers, schemas.SEEKERS), (config.raw_offers, schemas.RAW_OFFERS))
    ]
    try:
        return _run(spark, config, as_of, factory, *read)
    finally:
        # Otherwise a repeated run would meet the old records.
        for table in read:
            table.unpersist()


def _run(
    spark: SparkSession,
    config: EngineConfig,
    as_of: datetime,
    factory: ModelFactory,
    read_seekers: DataFrame,
    read_raw: DataFrame,
) -> dict[str, int]:
    day = as_of.date()
    (seekers, bad_seekers), (raw, bad_raw) = map(split_unreadable, (read_seekers, read_raw))
    if config.crawled:
        if config.keywords:
            captured = read_table(spark, config.pages, schemas.PAGES)
            keywords = read_records(spark, config.keywords, schemas.KEYWORDS)
            store_crawl(crawl(captured, frontier(keywords, config.base_url), as_of), config.crawled, day)
        raw = raw.unionByName(stored_offers(spark, config.crawled))
    aside = _set_aside(
        config, day, {"seekers": [bad_seekers], "raw_offers": [bad_raw, unusable_offers(raw)]}
    )

    offers = build_offers(
        raw,
        read_latest(spark, config.offers, schemas.OFFERS),
        read_skills(spark, config.skills),
        as_of,
        config.excluded_companies,
        config.recency_days,
        config.key_on,
    )
    pages = read_table(spark, config.pages, schemas.PAGES)
    alive = expire_by_pages(offers, pages, config.unavailable_tags)
    write_snapshot(alive, config.offers, day)
    offers = read_latest(spark, config.offers, schemas.OFFERS)

    seeker_root, offer_root = f"{config.embeddings}/users", f"{config.embeddings}/jobs"
    previous = read_latest(spark, seeker_root, schemas.SEEKER_EMBEDS)
    write_snapshot(embed_seekers(seekers, previous, factory), seeker_root, day)
    previous = read_latest(spark, offer_root, schemas.OFFER_EMBEDS)
    write_snapshot(
        embed_offers(offers, previous, factory, config.embed_limit), offer_root, day
    )

    words = read_table(spark, config.word_list, schemas.WORDS)
    found = recommend(
        offers,
        seekers,
        words,
        read_latest(spark, offer_root, schemas.OFFER_EMBEDS),
        read_latest(spark, seeker_root, schemas.SEEKER_EMBEDS),
        as_of,
        config.excluded_companies,
        config.english_threshold,
    )
    write_snapshot(found, config.matches, day)

    if config.report_users:
        matches = read_latest(spark, config.matches, schemas.MATCHES)
        users = spark.createDataFrame([(u,) for u in config.report_users], "user_id string")
        reports = report_lines(seeker_matches(matches, offers), users)
        write_reports(reports, config.reports, READING_ORDER)
    return aside
