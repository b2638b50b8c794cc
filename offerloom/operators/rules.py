"""Rule match between seekers and offers as an equi-join on exploded accept-lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import parse_bool, parse_number
from offerloom.operators.dedupe import keep_first, row_hash
from offerloom.operators.filters import not_listed
from offerloom.operators.skew import CELL_PAIRS, CELL_ROWS, grid_join, salted_join

RULE_KEYS = ("seniority", "location", "work_modality_english", "remote", "in_english")
# A criteria table up to this many narrow rows is sent to every task.
BROADCAST_ROWS = 1_000_000


def parse_seekers(seekers: DataFrame) -> DataFrame:
    """Typed profiles, one per user; rows with unreadable rules are dropped."""
    unique = keep_first(seekers, ["user_id"], [row_hash(seekers)])
    parsed = unique.select(
        "user_id",
        "seniority",
        "location",
        "work_modality_english",
        F.transform("remote", parse_bool).alias("remote"),
        parse_bool(F.col("english")).alias("english"),
        parse_number(F.col("role_weight")).alias("role_weight"),
        parse_number(F.col("similarity_threshold")).alias("similarity_threshold"),
    )
    return parsed.na.drop(
        "any", subset=["user_id", "seniority", "location", "work_modality_english", "remote",
                       "english"]
    )


def criteria(profiles: DataFrame) -> DataFrame:
    """``(user_id, rule keys)``: one row per accepted combination.

    The language rule is a fifth key: with English any offer passes, without it
    only offers that are not in English.
    """
    languages = F.when(F.col("english"), F.array(F.lit(True), F.lit(False))).otherwise(
        F.array(F.lit(False))
    )
    rows = profiles.select(
        "user_id", "seniority", "location", "work_modality_english", "remote",
        languages.alias("in_english"),
    )
    for name in RULE_KEYS:
        rows = rows.withColumn(name, F.explode(F.array_distinct(name)))
    return rows


def criteria_rows() -> Column:
    """Number of criteria rows of one profile, without exploding it."""
    count = F.when(F.col("english"), F.lit(2)).otherwise(F.lit(1)).cast("bigint")
    for name in ("seniority", "location", "work_modality_english", "remote"):
        count = count * F.size(F.array_distinct(name))
    return count


def rule_offers(offers: DataFrame, excluded_companies: Sequence[str]) -> DataFrame:
    """Narrow offer rows that may match: ``job_id`` and the rule keys."""
    return offers.where(not_listed(F.col("company"), excluded_companies)).select(
        "job_id", "seniority", "location", "work_modality_english", "remote",
        F.coalesce("is_english", F.lit(False)).alias("in_english"),
    )


def rule_condition(left: DataFrame, right: DataFrame, prefix: str) -> Column:
    parts = [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in RULE_KEYS]
    return reduce(lambda a, b: a & b, parts)


def match_rules(
    offers: DataFrame,
    profiles: DataFrame,
    excluded_companies: Sequence[str] = (),
    broadcast_rows: int | None = None,
    cell_pairs: int = CELL_PAIRS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(user_id, job_id)`` for every pair that satisfies the seeker's rules.

    ``offers`` carries ``is_english``. A criteria table of up to ``broadcast_rows`` rows is
    broadcast and offers are streamed past it; a larger one meets the offers in a grid join,
    in which a combination that most offers have and most seekers accept is many tasks.
    """
    narrow = rule_offers(offers, excluded_companies)
    wanted = criteria(profiles)
    total = profiles.agg(F.coalesce(F.sum(criteria_rows()), F.lit(0))).first()[0]
    if total <= (BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        side = wanted.select("user_id", *[F.col(k).alias(f"want_{k}") for k in RULE_KEYS])
        joined = narrow.join(F.broadcast(side), rule_condition(narrow, side, "want_"))
    else:
        joined = grid_join(narrow, wanted, RULE_KEYS, "job_id", "user_id", cell_pairs, cell_rows)
    return joined.select("user_id", "job_id")


def matched_totals(
    offers: DataFrame,
    profiles: DataFrame,
    number: Column,
    excluded_companies: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(user_id, n_offers, least, total)``: how many offers each seeker's rules admit, and the
    smallest and the sum of ``number``, an expression on ``job_id``, over them.

    The same as grouping ``match_rules`` by seeker, without its pairs: an offer has one
    combination of rule keys, so offers are summed up by combination and only these rows meet
    the criteria. A combination that most seekers accept is many tasks.
    """
    # One struct as the key: equal structs agree in their nulls too, and columns of one constant
    # are not taken out of the join.
    combination = F.struct(*RULE_KEYS).alias("combination")
    each = rule_offers(offers, excluded_companies).groupBy(combination).agg(
        F.count("*").alias("n_offers"), F.min(number).alias("least"), F.sum(number).alias("total")
    )
    wanted = criteria(profiles).select("user_id", combination)
    joined = salted_join(wanted, each, ["combination"], "user_id", cell_rows)
    return joined.groupBy("user_id").agg(
        F.sum("n_offers").alias("n_offers"), F.min("least").alias("least"), F.sum("total").alias("total")
    )
