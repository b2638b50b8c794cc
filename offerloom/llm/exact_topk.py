"""Exact top-k search by a vector-approximation file.

Components become integers, integers become cells: a row drops as many low bits as make
its cells fit a byte. The file of cells is scanned for lower bounds of all scores; the k-th
best one of a query is a threshold for all rows. A second scan finds the rows whose upper
bound reaches a threshold, and only those are read as exact vectors, which are scored best
bound first until the k-th result is certain. Scores are summed in 64-bit integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.vectors import Heaps, bounded_search, matrix, usable

SCALE = 256
#: Bits of a cell's number, its sign included.
CELL_BITS = 8
QUERY_EVERY = 50
K = 5
CHUNK = 32
#: Products of doubles are off by far less than this share of the largest terms.
ROUNDING = 2.0**-40


def _whole(data: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles."""
    return np.floor(SCALE * data)


class Cells:
    """Blocks as one number of dropped bits a row and one byte a component."""

    def __init__(self, queries: np.ndarray):
        self.queries = _whole(queries)
        self.most, self.least = np.maximum(self.queries, 0).sum(axis=1), np.minimum(self.queries, 0).sum(axis=1)
        self.size = np.abs(self.queries).sum(axis=1)

    @staticmethod
    def code(data: np.ndarray) -> bytes:
        whole = _whole(data)
        _, bits = np.frexp(np.abs(whole).max(axis=1) + 1)
        drop = np.maximum(bits - (CELL_BITS - 1), 0)
        cells = np.floor(whole / np.exp2(drop)[:, None]).clip(-128, 127).astype(np.int8)
        return np.int64(len(whole)).tobytes() + drop.astype(np.int16).tobytes() + cells.tobytes()

    def bounds(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        width = np.exp2(np.frombuffer(data, np.int16, n, 8).astype(np.float64))
        floor = np.frombuffer(data, np.int8, -1, 8 + 2 * n).reshape(n, -1) * width[:, None]
        about = self.queries @ floor.T
        error = ROUNDING * np.multiply.outer(self.size, np.abs(floor).max(axis=1) + width)
        above = width - 1
        lower = about + np.multiply.outer(self.least, above) - error
        return lower, about + np.multiply.outer(self.most, above) + error


def in_bound_order(k: int):
    """Visitors that score rows of exact vectors, best upper bound first."""

    class InBoundOrder:
        def __init__(self, group, ids, queries, bounds):
            self.ids, self.codec = ids, Cells(queries)
            self.heaps = Heaps(len(ids), k, bounds, np.int64)

        def add(self, own, data):
            block = matrix(data, self.codec.queries.shape[1])
            _, upper = self.codec.bounds(Cells.code(block))
            upper[self.ids[:, None] == own[None]] = -np.inf
            exact = _whole(block)
            if self.codec.size.max() * np.abs(exact).max() >= 2.0**62:
                raise OverflowError("scores do not fit 64 bits")
            exact, queries = exact.astype(np.int64), self.codec.queries.astype(np.int64)
            for q in np.flatnonzero((upper >= self.heaps.kth()[:, None]).any(axis=1)):
                places = np.flatnonzero((upper[q] >= self.heaps.kth()[q]) & (upper[q] > -np.inf))
                places = places[np.argsort(-upper[q][places], kind="stable")]
                for at in range(0, len(places), CHUNK):
                    part = places[at : at + CHUNK]
                    if upper[q][part[0]] < self.heaps.kth()[q]:
                        break
                    self.heaps.add(q, own[part], exact[part] @ queries[q])

        def rows(self):
            return self.heaps.rows(self.ids)

    return InBoundOrder


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of ``(id, vec)`` tables; scores are whole.

    Null vectors and vectors with null or non-finite components take no part; rows of
    another dimension do not meet. A query's own id is no result. Rows that repeat an id
    are results of their own; queries that repeat one count once. Ties go to the
    smaller id. Fewer than ``k`` candidates are all returned. Scores that may not fit 64
    bits are an error.
    """
    good, asked = vectors.where(usable("vec", False)), queries.where(usable("vec", False))
    return bounded_search(good, asked, k, Cells, in_bound_order(k), "long")


def self_search(table: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """Search ``embeddings`` with its rows whose vec_id is divisible by ``every``."""
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull())
    return exact_search(rows, rows.where(F.col("id") % every == 0), k)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM s)
SELECT * FROM r WHERE rank <= 5
"""
