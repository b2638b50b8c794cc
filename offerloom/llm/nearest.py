"""Nearest neighbours by a block matrix join on int8 tiles.

Each vector is stored as one scale and int8 components. The product of two tiles gives
approximate scores; by the triangle inequality the error is at most a sum of three norm
products, which gives every pair a lower and an upper bound. Tiles alone are joined: first
for each query's k-th best lower bound, then for the rows whose upper bound reaches it.
Original vectors are read for those rows only; surviving pairs are recomputed in double
precision and merged by heaps. The result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.vectors import Heaps, bounded_search, matrix, usable

QUERY_EVERY = 20
K = 20


class Tile:
    """int8 components with scales, and the norms that bound what rounding lost."""

    def __init__(self, data: np.ndarray):
        peak = np.abs(data).max(axis=1)
        self.scale = peak / 127
        with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
            whole = np.rint(np.where(peak[:, None] > 0, data / self.scale[:, None], 0))
        self.whole = np.nan_to_num(whole).clip(-127, 127).astype(np.int8)
        shown = self.whole * self.scale[:, None]
        self.shown = np.sqrt((shown * shown).sum(axis=1))
        lost = data - shown
        self.lost = np.sqrt((lost * lost).sum(axis=1))

    def bytes(self) -> bytes:
        return np.int64(len(self.whole)).tobytes() + b"".join(
            x.tobytes() for x in (self.scale, self.shown, self.lost, self.whole)
        )

    @classmethod
    def read(cls, blob: bytes) -> Tile:
        tile, n = cls.__new__(cls), int(np.frombuffer(blob, np.int64, 1)[0])
        tile.scale, tile.shown, tile.lost = np.frombuffer(blob, np.float64, 3 * n, 8).reshape(3, n)
        tile.whole = np.frombuffer(blob, np.int8, -1, 8 + 24 * n).reshape(n, -1)
        return tile

    def product(self, other: Tile) -> np.ndarray:
        """Approximate scores; sums of int8 products are whole numbers in either type."""
        kind = np.float32 if self.whole.shape[1] * 127 * 127 < 1 << 24 else np.float64
        tile = self.whole.astype(kind) @ other.whole.astype(kind).T
        return tile * self.scale[:, None] * other.scale[None]

    def error(self, other: Tile) -> np.ndarray:
        bound = np.multiply.outer(self.lost, other.shown + other.lost) + np.multiply.outer(self.shown, other.lost)
        # Rounding of the bound itself, and of the tile's scales.
        return bound * (1 + 1e-9) + 1e-6 * np.multiply.outer(self.shown + self.lost, other.shown + other.lost)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component on."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


class TileCodec:
    """Blocks as int8 tiles, and the bounds that a tile product gives."""

    def __init__(self, queries: np.ndarray):
        self.tile = Tile(queries)

    @staticmethod
    def code(data: np.ndarray) -> bytes:
        return Tile(data).bytes()

    def bounds(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        other = Tile.read(data)
        about, error = self.tile.product(other), self.tile.error(other)
        return about - error, about + error


def recompute(k: int):
    """Visitors that score the pairs whose upper bound reaches what their query holds."""

    class Recompute:
        def __init__(self, group, ids, queries, bounds):
            self.ids, self.queries, self.codec = ids, queries, TileCodec(queries)
            self.heaps = Heaps(len(ids), k, bounds)

        def add(self, own, data):
            block = matrix(data, self.queries.shape[1])
            _, upper = self.codec.bounds(TileCodec.code(block))
            survive = (upper >= self.heaps.kth()[:, None]) & (self.ids[:, None] != own[None])
            at_q, at_v = np.nonzero(survive)
            scores = exact_scores(self.queries[at_q], block[at_v])
            edges = np.searchsorted(at_q, np.arange(len(self.ids) + 1))
            for q in np.flatnonzero(np.diff(edges)):
                part = slice(edges[q], edges[q + 1])
                self.heaps.add(q, own[at_v[part]], scores[part])

        def rows(self):
            return self.heaps.rows(self.ids)

    return Recompute


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` by the largest inner product.

    Vectors that are null, zero or hold null or non-finite components take no part; rows
    of another dimension do not meet. A query's own id is no result. Rows that repeat an id
    are results of their own; queries that repeat one count once. Ties go to the smaller
    id. Fewer than ``k`` candidates are all returned.
    """
    good, asked = vectors.where(usable("vec", True)), queries.where(usable("vec", True))
    return bounded_search(good, asked, k, TileCodec, recompute(k), "double")


def self_nearest(table: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """Search ``embeddings`` with its rows whose vec_id is divisible by ``every``."""
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull())
    return nearest(rows, rows.where(F.col("id") % every == 0), k)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM s)
SELECT * FROM r WHERE rank <= 20
"""
