"""Weighted cosine scores of rule-matched pairs.

Offers and seekers that share rule keys are packed into blocks of up to ``BLOCK``
rows, and the rule join runs between blocks. A joined row is scored as one matrix
product, so a vector crosses to Python once per block of partners and not once per
pair, and pairs below the threshold never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.functions.vectors import weighted_score
from offerloom.operators.rules import (
    RULE_KEYS,
    criteria,
    criteria_rows,
    rule_condition,
    rule_offers,
)
from offerloom.operators.skew import CELL_PAIRS, grid_join, key_sizes

BLOCK = 256
# Seekers whose criteria rows, vectors included, stay below this are broadcast.
BROADCAST_BYTES = 256 << 20
# A rule key with more offers than this is cut into salts.
OFFERS_PER_SALT = BLOCK * 256
_PAIRS = pa.schema(
    [
        ("job_id", pa.string()),
        ("user_id", pa.string()),
        ("role", pa.float64()),
        ("skills", pa.float64()),
        ("role_weight", pa.float64()),
        ("similarity_threshold", pa.float64()),
    ]
)
_PAIRS_DDL = (
    "job_id string, user_id string, role double, skills double, role_weight double, "
    "similarity_threshold double"
)


def seekers_with_vectors(profiles: DataFrame, seeker_embeds: DataFrame) -> DataFrame:
    return profiles.join(seeker_embeds, "user_id").where(
        "role_weight is not null and similarity_threshold is not null"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; all vectors must be non-empty and of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or (len(widths) and (widths.min() != widths.max() or not widths.max())):
        raise ValueError("vectors must be non-empty and of equal length")
    return flat.reshape(len(column), -1)


def _packed(df: DataFrame, vectors: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """Rows with equal rule keys, packed into blocks within each Arrow batch.

    Vectors of a block are laid end to end in one array. Packing needs no shuffle:
    a common key fills its blocks, a rare one gives small blocks.
    """
    columns = [*scalars, *vectors]
    lists = [
        f"{c} {t if t.startswith('array') else f'array<{t}>'}"
        for c, t in ((c, df.schema[c].dataType.simpleString()) for c in columns)
    ]
    keys = [f"{k} {df.schema[k].dataType.simpleString()}" for k in RULE_KEYS]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key_columns = [batch.column(k) for k in RULE_KEYS]
            members: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*[c.to_pylist() for c in key_columns])):
                members.setdefault(key, []).append(at)
            pieces = [
                np.array(rows[i : i + BLOCK])
                for rows in members.values()
                for i in range(0, len(rows), BLOCK)
            ]
            order = np.concatenate(pieces)
            starts = np.cumsum([0, *map(len, pieces)])
            firsts = pa.array(np.array([p[0] for p in pieces]))
            arrays = [c.take(firsts) for c in key_columns]
            for name in scalars:
                values = batch.column(name).take(pa.array(order))
                arrays.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values))
            for name in vectors:
                rows = _matrix(batch.column(name))
                ends = pa.array(starts * rows.shape[1], pa.int32())
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(rows[order].ravel())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*RULE_KEYS, *columns])

    return df.select(*RULE_KEYS, *columns).mapInArrow(pack, ", ".join([*keys, *lists]))


def _directions(flat: pa.ListArray, row: int, count: int) -> np.ndarray:
    """Unit vectors of one block; a zero vector has no direction and gives NaN."""
    vectors = flat.slice(row, 1).flatten().to_numpy(zero_copy_only=False)
    vectors = vectors.astype(np.float64).reshape(count, -1)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.full_like(vectors, np.nan), where=norms > 0)


def _similar(offer: np.ndarray, seeker: np.ndarray) -> np.ndarray:
    if offer.shape[1] != seeker.shape[1]:
        raise ValueError("vectors must be non-empty and of equal length")
    return offer @ seeker.T


def _score_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):

            def values(name: str) -> pa.Array:
                return batch.column(name).slice(row, 1).flatten()

            jobs, users = values("job_id"), values("user_id")
            weights = values("role_weight").to_numpy()
            thresholds = values("similarity_threshold").to_numpy()

            def block(name: str, count: int) -> np.ndarray:
                return _directions(batch.column(name), row, count)

            role = _similar(
                block("offer_role", len(jobs)), block("seeker_role", len(users))
            )
            skills = _similar(
                block("offer_skills", len(jobs)), block("seeker_skills", len(users))
            )
            # Rounding to four places moves a similarity by at most 5e-5: keep that
            # much slack here and let the exact test follow on the rounded values.
            slack = 1e-4 * (np.abs(weights) + np.abs(1 - weights)) + 1e-9
            mixed = role * weights + skills * (1 - weights)
            i, j = np.nonzero(mixed >= thresholds - slack)
            if i.size:
                yield pa.RecordBatch.from_arrays(
                    [
                        jobs.take(pa.array(i)),
                        users.take(pa.array(j)),
                        pa.array(role[i, j]),
                        pa.array(skills[i, j]),
                        pa.array(weights[j]),
                        pa.array(thresholds[j]),
                    ],
                    schema=_PAIRS,
                )


def score_matches(
    offers: DataFrame,
    offer_embeds: DataFrame,
    profiles: DataFrame,
    seeker_embeds: DataFrame,
    excluded_companies: Sequence[str] = (),
    broadcast_bytes: int | None = None,
    offers_per_salt: int | None = None,
) -> DataFrame:
    """``(user_id, job_id, score)`` at or above each seeker's threshold.

    Seekers of a checked size are broadcast and offers stream past them. Otherwise
    blocks meet in a grid join on the rule keys, which cuts hot ones on both sides. An undefined score never
    passes.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    seekers = seekers_with_vectors(profiles, seeker_embeds)
    width = F.size("avg_role_embeds") + F.size("avg_skill_embeds")
    seeker_bytes = seekers.agg(
        F.coalesce(F.sum(criteria_rows() * width * 8), F.lit(0))
    ).first()[0]

    narrow = rule_offers(offers, excluded_companies)
    offer_rows = narrow.join(
        offer_embeds.select(
            "job_id",
            F.col("role_embeds").alias("offer_role"),
            F.col("avg_skill_embeds").alias("offer_skills"),
        ),
        "job_id",
    )
    seeker_rows = criteria(seekers).join(
        seekers.select(
            "user_id",
            "role_weight",
            "similarity_threshold",
            F.col("avg_role_embeds").alias("seeker_role"),
            F.col("avg_skill_embeds").alias("seeker_skills"),
        ),
        "user_id",
    )
    left = _packed(offer_rows, ["offer_role", "offer_skills"], ["job_id"])
    right = _packed(
        seeker_rows,
        ["seeker_role", "seeker_skills"],
        ["user_id", "role_weight", "similarity_threshold"],
    )
    if seeker_bytes <= limit:
        side = right.withColumnsRenamed({k: f"want_{k}" for k in RULE_KEYS})
        joined = left.join(F.broadcast(side), rule_condition(left, side, "want_"))
    else:
        joined = grid_join(
            left,
            right,
            RULE_KEYS,
            "job_id",
            "user_id",
            CELL_PAIRS,
            OFFERS_PER_SALT if offers_per_salt is None else offers_per_salt,
            (key_sizes(narrow, RULE_KEYS), key_sizes(criteria(seekers), RULE_KEYS)),
        )
    pairs = joined.select(
        "job_id", "user_id", "role_weight", "similarity_threshold", "offer_role",
        "offer_skills", "seeker_role", "seeker_skills",
    ).mapInArrow(_score_blocks, _PAIRS_DDL)
    score = weighted_score(
        F.bround("role", 4), F.bround("skills", 4), F.col("role_weight")
    )
    return (
        pairs.withColumn("score", score)
        .where(F.col("score") >= F.col("similarity_threshold"))
        .select("user_id", "job_id", "score")
    )
