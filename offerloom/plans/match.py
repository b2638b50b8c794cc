"""Recommendations for all seekers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.functions.dates import as_of_column
from offerloom.functions.keys import match_key
from offerloom.operators.language import DEFAULT_THRESHOLD, english_flags
from offerloom.operators.rules import match_rules, parse_seekers
from offerloom.operators.scoring import score_matches
from offerloom.schemas import MATCHES


def with_language(
    offers: DataFrame, words: DataFrame, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Narrow rule columns of the offers with ``is_english``, computed once per offer."""
    flags = english_flags(offers, "job_id", "description", words, threshold)
    narrow = offers.select(
        "job_id", "seniority", "location", "work_modality_english", "remote", "company"
    )
    return narrow.join(flags.select("job_id", "is_english"), "job_id", "left")


def rule_matches(
    offers: DataFrame,
    seekers: DataFrame,
    words: DataFrame,
    excluded_companies: Sequence[str] = (),
    user_id: str | None = None,
) -> DataFrame:
    """``(user_id, job_id)`` pairs that satisfy the rules, for all seekers or for one."""
    if user_id is not None:
        seekers = seekers.where(F.col("user_id") == user_id)
    return match_rules(with_language(offers, words), parse_seekers(seekers), excluded_companies)


def recommend(
    offers: DataFrame,
    seekers: DataFrame,
    words: DataFrame,
    offer_embeds: DataFrame,
    seeker_embeds: DataFrame,
    as_of: datetime | str,
    excluded_companies: Sequence[str] = (),
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Scored matches of every seeker at or above the seeker's threshold."""
    scored = score_matches(
        with_language(offers, words, threshold),
        offer_embeds,
        parse_seekers(seekers),
        seeker_embeds,
        excluded_companies,
    )
    return scored.select(
        "user_id",
        "job_id",
        match_key(F.col("user_id"), F.col("job_id")).alias("match_id"),
        as_of_column(as_of).cast("date").alias("match_date"),
        "score",
    ).select(*MATCHES.fieldNames())
