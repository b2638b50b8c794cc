"""Raw offers to clean offers: key, flag, tag, merge, filter, deduplicate."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.dates import is_recent, parse_timestamp
from offerloom.functions.keys import stable_key
from offerloom.functions.text import is_remote
from offerloom.functions.urls import canonical_url, strip_query
from offerloom.operators.dedupe import (
    SOURCE_RANK,
    keep_first,
    keep_first_in_sequence,
    union_new_first,
)
from offerloom.operators.filters import not_listed
from offerloom.operators.tagging import with_tags
from offerloom.schemas import OFFERS, RAW_OFFERS

_TIE = "__tie"
_SCANNED = "scraping_date"


def _merge_order() -> list[Column]:
    return [F.col(SOURCE_RANK), F.desc_nulls_last(_SCANNED), F.col(_TIE)]


def _clean_order() -> list[Column]:
    return [
        F.desc("publication_date"),
        F.col(SOURCE_RANK),
        F.desc_nulls_last(_SCANNED),
        F.col("job_id"),
    ]


def unusable_reason(strict_dates: bool = False) -> Column:
    """Why a raw row cannot be processed; null for good rows."""
    reason = F.when(F.col("link").isNull(), "link missing").when(
        F.col("description").isNull(), "description missing"
    )
    if not strict_dates:
        unreadable = F.col("publication_date").isNotNull() & parse_timestamp(
            F.col("publication_date")
        ).isNull()
        reason = reason.when(unreadable, "publication_date unreadable")
    return reason


def split_unusable(raw: DataFrame, strict_dates: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rest with a ``reason``, so that one bad row stops nothing."""
    marked = raw.withColumn("reason", unusable_reason(strict_dates))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def _raw_fields(raw: DataFrame) -> DataFrame:
    """The fields of raw offers; missing columns become null."""
    present = set(raw.columns)
    cols = [
        (F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in RAW_OFFERS.fields
    ]
    return raw.select(*cols)


def unusable_offers(raw: DataFrame, strict_dates: bool = False) -> DataFrame:
    """``(reason, record)`` of the raw rows that ``build_offers`` cannot process."""
    _, bad = split_unusable(_raw_fields(raw), strict_dates)
    return bad.select("reason", F.to_json(F.struct(*RAW_OFFERS.fieldNames())).alias("record"))


def _aligned_raw(raw: DataFrame, key_on: str, strict_dates: bool) -> DataFrame:
    """Raw rows with key and remote flag; missing columns become null."""
    link = F.col("link") if key_on == "raw" else canonical_url(F.col("link"))
    good, _ = split_unusable(_raw_fields(raw), strict_dates)
    return good.select(
        *[F.col(f.name) for f in RAW_OFFERS.fields if f.name not in ("publication_date", _SCANNED)],
        parse_timestamp(F.col("publication_date"), strict_dates).alias("publication_date"),
        parse_timestamp(F.col(_SCANNED)).cast("date").alias(_SCANNED),
        stable_key(link).alias("job_id"),
        is_remote(F.col("description"), F.col("vacancy_name")).alias("remote"),
        F.lit(None).cast("boolean").alias("available"),
        F.xxhash64(*[f.name for f in RAW_OFFERS.fields]).alias(_TIE),
    )


def _aligned_existing(existing: DataFrame) -> DataFrame:
    return existing.withColumns(
        {
            "publication_date": F.col("publication_date").cast("timestamp_ntz"),
            _TIE: F.xxhash64(*[f.name for f in RAW_OFFERS.fields]),
        }
    )


def augment(
    raw: DataFrame,
    existing: DataFrame,
    skills: DataFrame,
    key_on: str = "raw",
    strict_dates: bool = False,
) -> DataFrame:
    """Keyed, flagged and tagged raw rows merged over the existing offers.

    ``publication_date`` is still a timestamp here and ``source_rank`` tells new
    rows (0) from existing ones (1); ``transform`` needs both.
    """
    fresh = with_tags(_aligned_raw(raw, key_on, strict_dates), "job_id", "description", skills)
    merged = union_new_first(fresh, _aligned_existing(existing))
    unique = keep_first(merged, ["job_id"], _merge_order())
    return unique.where("remote is not null and skills is not null").drop(_TIE)


def transform(
    augmented: DataFrame,
    as_of: datetime | str,
    excluded_companies: Sequence[str] = (),
    recency_days: int = 7,
) -> DataFrame:
    """Excluded companies out, links cleaned, old offers out, then one row per link
    and one per description, the newest first."""
    kept = augmented.where(
        not_listed(F.col("company"), excluded_companies)
        & is_recent(F.col("publication_date"), as_of, recency_days)
    )
    return _clean(kept)


def _clean(kept: DataFrame) -> DataFrame:
    dated = kept.withColumns(
        {
            "link": strip_query(F.col("link")),
            "publication_date": F.col("publication_date").cast("date"),
        }
    )
    unique = keep_first_in_sequence(
        dated, [["link"], ["description"]], _clean_order(), long_keys=True
    )
    return unique.select(*OFFERS.fieldNames())


def build_offers(
    raw: DataFrame,
    existing: DataFrame,
    skills: DataFrame,
    as_of: datetime | str,
    excluded_companies: Sequence[str] = (),
    recency_days: int = 7,
    key_on: str = "raw",
    strict_dates: bool = False,
) -> DataFrame:
    """``transform(augment(...))`` with less data in the merge shuffle.

    A row that fails the company or date filter can still displace an older row
    with its key, but never be part of the result. Such rows travel as bare keys:
    their texts are set to null and not tagged.
    """
    may_stay = (
        not_listed(F.col("company"), excluded_companies)
        & is_recent(F.col("publication_date"), as_of, recency_days)
    )
    order_cols = ("job_id", _SCANNED, _TIE)

    def masked(df: DataFrame) -> DataFrame:
        stays = F.coalesce(may_stay, F.lit(False)).alias("stays")
        flagged = df.select("*", stays)
        return flagged.select(
            *[
                c if c in order_cols else F.when(F.col("stays"), F.col(c)).alias(c)
                for c in df.columns
            ],
            "stays",
        )

    fresh = with_tags(
        masked(_aligned_raw(raw, key_on, strict_dates)),
        "job_id",
        "description",
        skills,
        when=F.col("stays"),
    )
    merged = union_new_first(fresh, masked(_aligned_existing(existing)))
    unique = keep_first(merged, ["job_id"], _merge_order())
    return _clean(unique.where("stays and remote is not null and skills is not null"))


def newest_first(offers: DataFrame) -> DataFrame:
    return offers.orderBy(F.desc("publication_date"), "job_id")


def title_extract(
    offers: DataFrame, industries: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Titles and descriptions of chosen industries; all of them unless ``limit`` is set."""
    chosen = offers.where(F.col("industries").isin(list(industries)))
    ordered = [F.desc("publication_date"), F.col("job_id")]
    picked = chosen if limit is None else chosen.orderBy(*ordered).limit(limit)
    return picked.select("vacancy_name", "description")
