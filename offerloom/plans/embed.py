"""Incremental embedding of offers and seekers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.vectors import mean_vector
from offerloom.operators.dedupe import keep_first, row_hash
from offerloom.operators.embedding import ModelFactory, embed_phrases
from offerloom.operators.filters import first_rows, ids_missing_from, ids_present_in
from offerloom.operators.skew import salted_join


def _labelled(out: str, col: str) -> Column:
    """Array of ``(out, phrase)`` for one phrase list; a null list counts as empty."""
    phrases = F.coalesce(F.col(col), F.array().cast("array<string>"))
    return F.transform(phrases, lambda p: F.struct(F.lit(out).alias("out"), p.alias("phrase")))


def _pooled(
    df: DataFrame,
    key: str,
    lists: dict[str, str],
    factory: ModelFactory,
    partitions: int | None,
) -> DataFrame:
    """Mean vector per key for each phrase list: ``lists`` maps output to list column.

    Rows with an empty list have no mean and are dropped.
    """
    entries = [_labelled(out, col) for out, col in lists.items()]
    listed = df.select(key, F.inline(F.concat(*entries))).where("phrase is not null")
    vectors = embed_phrases(listed, factory, partitions=partitions)
    joined = salted_join(listed, vectors, ["phrase"], key)
    # What is gathered per key is no more than the phrase lists of its own row.
    means = [
        mean_vector(F.collect_list(F.when(F.col("out") == out, F.col("vector"))))
        .cast("array<float>")
        .alias(out)
        for out in lists
    ]
    return joined.groupBy(key).agg(*means).na.drop("any")


def embed_offers(
    offers: DataFrame,
    previous: DataFrame,
    factory: ModelFactory,
    limit: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Embeddings of all offers ever seen: missing ones are computed, old ones kept.

    ``limit`` bounds how many offers one run embeds, the newest first.
    """
    # What has no title or skills has no embedding, so it takes neither work nor limit.
    has_skill = F.exists(F.coalesce("skills", F.array().cast("array<string>")), lambda s: s.isNotNull())
    able = offers.where(F.col("vacancy_name").isNotNull() & has_skill)
    missing = ids_missing_from(able, previous, "job_id")
    missing = first_rows(missing, [F.desc("publication_date"), F.col("job_id")], limit)
    titled = missing.select("job_id", "skills", F.array("vacancy_name").alias("titles"))
    lists = {"avg_skill_embeds": "skills", "role_embeds": "titles"}
    fresh = _pooled(titled, "job_id", lists, factory, partitions)
    # Ids are disjoint by the anti-join, so a plain union is already an upsert.
    return fresh.unionByName(previous.na.drop("any").select(*fresh.columns))


def embed_seekers(
    seekers: DataFrame,
    previous: DataFrame,
    factory: ModelFactory,
    partitions: int | None = None,
) -> DataFrame:
    """Embeddings of the seekers that exist now; those of former seekers are dropped.

    Of several records of a seeker, the one that the rules use counts.
    """
    seekers = keep_first(seekers, ["user_id"], [row_hash(seekers)])
    kept = ids_present_in(previous, seekers, "user_id")
    missing = ids_missing_from(seekers, kept, "user_id")
    lists = {"avg_skill_embeds": "skills", "avg_role_embeds": "job_titles"}
    fresh = _pooled(missing, "user_id", lists, factory, partitions)
    return fresh.unionByName(kept.na.drop("any").select(*fresh.columns))
