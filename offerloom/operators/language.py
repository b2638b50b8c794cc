"""Share of a text's tokens that a word list knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import tokens
from offerloom.operators.sizing import broadcast_if_small

DEFAULT_THRESHOLD = 0.6


def token_hits(
    df: DataFrame, id_col: str, text_col: str, words: DataFrame, word_col: str = "word"
) -> DataFrame:
    """``(id, n_tokens, n_hits)`` for every row; ids must be unique.

    The word list is matched as written, while tokens are lowercased. All tokens
    of a text sit in one map task, so the partial aggregate sends one narrow row
    per text through the shuffle.
    """
    known = broadcast_if_small(
        words.select(F.col(word_col).alias("token")).where("token is not null").distinct(),
        text_cols=("token",),
    ).withColumn("known", F.lit(1))
    exploded = df.select(F.col(id_col), F.explode_outer(tokens(F.col(text_col))).alias("token"))
    return (
        exploded.join(known, "token", "left")
        .groupBy(id_col)
        .agg(F.count("token").alias("n_tokens"), F.count("known").alias("n_hits"))
    )


def english_flags(
    df: DataFrame,
    id_col: str,
    text_col: str,
    words: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Add ``is_english`` to the counts: the share reaches the threshold; no tokens, no."""
    share = F.try_divide(F.col("n_hits"), F.col("n_tokens"))
    return token_hits(df, id_col, text_col, words).withColumn(
        "is_english", F.coalesce(share >= F.lit(threshold), F.lit(False))
    )
