"""Centroid clustering of whole-number vectors by scalar look-up tables.

Vectors become whole numbers and are packed once into blocks. A block holds, for each
dimension, the values that occur in it and every vector's place among them. In each round
the squared difference of every occurring value to every centroid is tabulated per
dimension; distances of all vectors of the block are gathers from those tables and their
sums. Blocks stay where they are: only one row of sums for each task and cluster moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import staged
from offerloom.llm.vectors import usable

BLOCK_ROWS = 4_096
#: Whole numbers up to this size keep every distance of a vector within 63 bits.
MOST = 1 << 27
_BLOCK = "ids binary, nulls binary, size int, values binary, ends binary, places binary"


def whole_numbers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """``(id, vec)`` of the vectors of ``dim`` finite components, as floor(scale * x) in doubles."""
    kept = usable("embedding", nonzero=False) & (F.size("embedding") == dim)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(kept).select(F.col("vec_id").cast("bigint").alias("id"), whole.alias("vec"))


def starts(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash smallest, in that order: the first centroids."""
    seed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = vectors.select("vec", seed.alias("seed")).orderBy(F.col("seed").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r["vec"] for r in rows], np.float64).astype(np.int64)


def packed(vectors: DataFrame, dim: int) -> DataFrame:
    """Blocks of vectors: ids, occurring values by dimension, and places among them."""

    def block(ids: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
        rows = flat.reshape(-1, dim)
        if len(rows) and np.abs(rows).max() > MOST:
            raise ValueError(f"a component beyond {MOST} after scaling: its distances may not fit a long")
        rows = rows.astype(np.int64)
        values, ends, places = [], [0], np.empty((dim, len(rows)), np.uint16)
        for d in range(dim):
            own, places[d] = np.unique(rows[:, d], return_inverse=True)
            values.append(own)
            ends.append(ends[-1] + len(own))
        blobs = (
            ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
            ids.is_null().to_numpy(zero_copy_only=False),
        )
        parts = (np.concatenate(values), np.array(ends, np.int64), places)
        return pa.RecordBatch.from_arrays(
            [*[pa.array([b.tobytes()], pa.binary()) for b in blobs], pa.array([len(rows)], pa.int32()),
             *[pa.array([b.tobytes()], pa.binary()) for b in parts]],
            names=["ids", "nulls", "size", "values", "ends", "places"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                yield block(part.column("id"), part.column("vec").flatten().to_numpy(zero_copy_only=False))

    return vectors.mapInArrow(blocks, _BLOCK)


class _Block:
    """A block as read back in a task."""

    def __init__(self, batch: pa.RecordBatch, at: int, dim: int):
        def numbers(name: str, dtype: type) -> np.ndarray:
            return np.frombuffer(batch.column(name)[at].as_py(), dtype)

        self.ids, self.nulls = numbers("ids", np.int64), numbers("nulls", np.bool_)
        self.values, self.ends = numbers("values", np.int64), numbers("ends", np.int64)
        self.places = numbers("places", np.uint16).reshape(dim, len(self.ids))

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid, the smaller of equals, and its squared distance."""
        total = np.zeros((len(self.ids), len(centroids)), np.int64)
        for d, places in enumerate(self.places):
            own = self.values[self.ends[d] : self.ends[d + 1]]
            table = (own[:, None] - centroids[None, :, d]) ** 2
            total += table[places]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sum of the components of each cluster's vectors, from counts of occurring values."""
        out = np.zeros((k, len(self.places)), np.int64)
        for d, places in enumerate(self.places):
            own = self.values[self.ends[d] : self.ends[d + 1]]
            counts = np.bincount(cluster * len(own) + places, minlength=k * len(own))
            out[:, d] = counts.reshape(k, len(own)) @ own
        return out


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; those of empty clusters as they were."""
    k, dim = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                block = _Block(batch, at, dim)
                cluster, _ = block.nearest(centroids)
                counts += np.bincount(cluster, minlength=k)
                sums += block.sums(cluster, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = blocks.mapInArrow(summed, "cluster int, n long, sums array<long>").where("n > 0")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("d", "part"))
    rows = each.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["d"]] = r["total"] // r["n"]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, cluster, distance)`` of every packed vector."""
    dim = centroids.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = _Block(batch, at, dim)
                cluster, distance = block.nearest(centroids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, mask=block.nulls), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    names=["id", "cluster", "distance"],
                )

    return blocks.mapInArrow(rows, "id long, cluster int, distance long")


def fit(vectors: DataFrame, dim: int, scale: int, k: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Packed blocks of the usable vectors, and the centroids after ``rounds`` rounds."""
    whole = whole_numbers(vectors, dim, scale)
    centroids = starts(whole, k)
    blocks = staged(packed(whole, dim), "cluster-blocks")
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(blocks, centroids)
    return blocks, centroids


def _digest(centroids: np.ndarray) -> Column:
    """The hash of each cluster's centroid, by ``cluster``."""
    written = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return F.element_at(F.array(*[F.lit(x) for x in written]), F.col("cluster") + 1)


def cluster_vectors(vectors: DataFrame, dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable vector.

    Vectors that are null, have another number of components, or hold null or non-finite ones
    take no part. Every row of a repeated vec_id is one vector; equal ids and ids that are null
    are ordered by their components where starts are chosen, null ids last. Fewer than ``k``
    vectors give as many clusters. A component beyond ``MOST`` after scaling is an error, as
    distances would not fit a long. Other columns are ignored; an empty table gives no rows.
    """
    blocks, centroids = fit(vectors, dim, scale, k, rounds)
    if not len(centroids):
        columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], columns)
    found = staged(assigned(blocks, centroids), "cluster-rows")
    parts = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    own = {r["cluster"]: int(r["own"]) for r in parts}
    each = F.array(*[F.lit(own.get(c, 0)).cast("long") for c in range(len(centroids))])
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.element_at(each, F.col("cluster") + 1).alias("cluster_inertia"),
        F.lit(sum(own.values())).cast("long").alias("inertia"), _digest(centroids).alias("centroid_sha256"),
    )


def oracle_sql(dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3) -> str:
    """The clustering as one statement: a pair of tables for each round."""
    parts = [f"""
v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS c
    FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
),
c0 AS (
    SELECT row_number() OVER (ORDER BY s) - 1 AS j, c
    FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS s, c FROM v ORDER BY s LIMIT {k})
)"""]
    near = """
a{0} AS (
    SELECT r, vec_id, v.c, arg_min(j, (d, j)) AS j, min(d) AS d
    FROM (SELECT r, vec_id, v.c, j, list_sum(list_transform(list_zip(v.c, c{0}.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
          FROM v, c{0}) v
    GROUP BY r, vec_id, v.c
)"""
    for n in range(rounds):
        parts.append(near.format(n))
        parts.append(f"""
s{n} AS (
    SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS m
    FROM (SELECT j, unnest(c) AS x, unnest(range({dim})) AS i FROM a{n}) GROUP BY j, i
),
c{n + 1} AS (
    SELECT j, coalesce(e.c, o.c) AS c
    FROM c{n} o LEFT JOIN (
        SELECT j, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS c FROM s{n} GROUP BY j
    ) e USING (j)
)""")
    parts.append(near.format(rounds))
    return f"""
WITH {",".join(parts)}
SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(o.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} o USING (j)
"""


ORACLE_SQL = oracle_sql()
