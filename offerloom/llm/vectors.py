"""Vectors in blocks: packing, and meeting a stated query set in a grid of blocks.

Vectors are packed into blocks where they are scanned. Query groups and blocks meet on
``(dim, group, slot)``: a block belongs to one slot and is repeated per query group, a
query group is repeated per slot, so that work is dealt evenly and no task holds more
than a block and a group at a time.

A search has three steps. Blocks of coded vectors, a byte for each component, give bounds of
all scores: first each query's k-th best lower bound, then the rows that some query of a
group may need. Only those rows are read as exact vectors, packed and scored. Codes and
vectors are tables of their own, so rows that no query needs are never read in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import staged

BLOCK_ROWS = 4_096
GROUP_ROWS = 2_048
SLOTS = 24


def usable(vec: str, nonzero: bool) -> Column:
    """Vectors that are not null, not empty and hold finite numbers only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(False))
    return kept & F.exists(vec, lambda x: x != 0) if nonzero else kept


def plain(data: np.ndarray) -> bytes:
    return data.astype("<f8").tobytes()


def matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<f8").reshape(-1, dim)


def pack(vectors: DataFrame, rows: int, code: Callable[[np.ndarray], bytes] = plain) -> DataFrame:
    """``(group, dim, ids, data, bounds)`` blocks of rows ``(id, vec[, bound][, group])``.

    A block is of one dimension and one group (0 where rows name none; rows of a group must
    follow each other). ``code`` turns a block of doubles into bytes.
    """
    has_bound, has_group = "bound" in vectors.columns, "group" in vectors.columns

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        group = 0

        def flush(dim: int) -> pa.RecordBatch:
            ids, data, bound = (np.concatenate(x) for x in zip(*held.pop(dim)))
            values = [group, dim, ids.tobytes(), code(data), bound.tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds)], names=["group", "dim", "ids", "data", "bounds"]
            )

        def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
            if not has_group:
                yield 0, batch
                return
            names = batch.column("group").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield int(names[a]), batch.slice(a, b - a)

        for batch in batches:
            for name, run in runs(batch):
                if name != group:
                    for dim in list(held):
                        yield flush(dim)
                    group = name
                for at in range(0, run.num_rows, rows):
                    part = run.slice(at, rows)
                    vec = part.column("vec")
                    sizes = np.diff(np.asarray(vec.offsets))
                    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    ends = np.cumsum(sizes)
                    ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                    bound = np.zeros(len(ids))
                    if has_bound:
                        bound = part.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
                    for dim in np.unique(sizes):
                        pick = np.flatnonzero(sizes == dim)
                        at_flat = (ends[pick] - dim)[:, None] + np.arange(dim)
                        held.setdefault(int(dim), []).append((ids[pick], flat[at_flat], bound[pick]))
                        if sum(len(x[0]) for x in held[int(dim)]) >= rows:
                            yield flush(int(dim))
        for dim in list(held):
            yield flush(dim)

    return vectors.mapInArrow(blocks, "group long, dim int, ids binary, data binary, bounds binary")


def met(blocks: DataFrame, queries: DataFrame, own_group: bool = False, slots: int = SLOTS) -> DataFrame:
    """Pairs of a block and a query group, dealt by ``(group, slot)``; groups in order.

    A block meets all groups of its dimension, or with ``own_group`` the one it names.
    """
    groups = queries.select(
        F.col("dim").alias("q_dim"), F.xxhash64("ids").alias("q_group"), F.col("ids").alias("q_ids"),
        F.col("data").alias("q_data"), F.col("bounds").alias("q_bounds"),
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
    )
    dealt = blocks.drop("bounds").withColumn("own_slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
    if not own_group:
        keys = groups.select("q_dim", "q_group").distinct().groupBy("q_dim").agg(F.collect_list("q_group").alias("all_groups"))
        dealt = dealt.drop("group").join(keys, F.col("dim") == F.col("q_dim")).drop("q_dim")
        dealt = dealt.withColumn("group", F.explode("all_groups")).drop("all_groups")
    joined = dealt.join(groups, F.expr("dim = q_dim and group = q_group and own_slot = slot"))
    return joined.select("dim", "group", "ids", "data", "q_ids", "q_data", "q_bounds").sortWithinPartitions("group")


def over_groups(pairs: DataFrame, visitor: Callable, schema: str) -> DataFrame:
    """Rows that visitors give: one visitor for each query group of a task.

    ``visitor(group, ids, queries, bounds)`` has ``add(ids, data)`` for every block and
    ``rows()`` at the end; both return columns in the order of ``schema``, or ``None``.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = None, None

        def batch_of(columns):
            if columns is not None and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["group"] != group:
                    if now is not None:
                        yield from batch_of(now.rows())
                    group, bounds = row["group"], np.frombuffer(row["q_bounds"], np.float64)
                    now = visitor(group, np.frombuffer(row["q_ids"], np.int64), matrix(row["q_data"], row["dim"]), bounds)
                yield from batch_of(now.add(np.frombuffer(row["ids"], np.int64), row["data"]))
        if now is not None:
            yield from batch_of(now.rows())

    return pairs.mapInArrow(visit, schema)


def bounded_search(vectors: DataFrame, queries: DataFrame, k: int, codec: type, scorer: Callable, kind: str) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best rows of each query.

    ``codec.code(data)`` gives a block's bytes and ``codec(queries).bounds(data)`` lower and upper
    bounds of all scores. ``scorer(group, ids, queries, bounds)`` is the visitor that
    scores exact vectors; scores are of type ``kind``.
    """

    class Floors:
        """The k best lower bounds of each query."""

        def __init__(self, group, ids, queries, bounds):
            self.ids, self.codec, self.kept = ids, codec(queries), np.full((len(ids), k), -np.inf)

        def add(self, own, data):
            lower, _ = self.codec.bounds(data)
            lower[self.ids[:, None] == own[None]] = -np.inf
            both = np.concatenate([self.kept, lower], axis=1)
            self.kept = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]

        def rows(self):
            full = self.kept > -np.inf
            return np.repeat(self.ids, full.sum(axis=1)), self.kept[full]

    class Needed:
        """Rows that one of the group's queries may need, each once."""

        def __init__(self, group, ids, queries, bounds):
            self.group, self.ids, self.codec, self.floor = group, ids, codec(queries), bounds

        def add(self, own, data):
            _, upper = self.codec.bounds(data)
            upper[self.ids[:, None] == own[None]] = -np.inf
            found = np.unique(own[((upper >= self.floor[:, None]) & (upper > -np.inf)).any(axis=0)])
            return np.full(len(found), self.group), found

        def rows(self):
            return None

    good = staged(vectors, "search-vectors")
    codes = staged(pack(good, BLOCK_ROWS, codec.code), "search-codes")
    asked = staged(first_of_each(queries), "search-queries")
    lower = over_groups(met(codes, pack(asked, GROUP_ROWS)), Floors, "id long, bound double")
    top = F.slice(F.sort_array(F.collect_list("bound"), asc=False), 1, k)
    # With fewer than k rows in all, every row stays a candidate.
    bounds = lower.groupBy("id").agg(top.alias("top")).select(
        "id", F.when(F.size("top") == k, F.array_min("top")).otherwise(float("-inf")).alias("bound")
    )
    groups = staged(pack(asked.join(bounds, "id"), GROUP_ROWS), "search-groups")
    needed = over_groups(met(codes, groups), Needed, "group long, id long").distinct()
    exact = needed.join(good, "id").select("group", "id", "vec").sortWithinPartitions("group")
    pairs = met(pack(exact, BLOCK_ROWS), groups, own_group=True)
    return best(over_groups(pairs, scorer, f"query_id long, vec_id long, score {kind}"), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class Heaps:
    """The ``k`` best of each query of one group, kept as sorted rows."""

    def __init__(self, queries: int, k: int, floor: np.ndarray, dtype: type = np.float64):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.zeros((queries, k), dtype), np.full((queries, k), np.iinfo(np.int64).max)
        self.held = np.zeros(queries, np.int64)

    def kth(self) -> np.ndarray:
        """What a score must reach to matter, as a double."""
        return np.maximum(np.where(self.held == self.k, self.scores[:, -1], -np.inf), self.floor)

    def add(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        held = self.held[row]
        ids, scores = np.concatenate([self.ids[row, :held], ids]), np.concatenate([self.scores[row, :held], scores])
        # Ascending by score and descending by id, read from the end: whole numbers need no sign change.
        order = np.lexsort((~ids, scores))[::-1][: self.k]
        self.held[row] = len(order)
        self.ids[row, : len(order)], self.scores[row, : len(order)] = ids[order], scores[order]

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.arange(self.k)[None] < self.held[:, None]
        return np.repeat(query_ids, self.held), self.ids[full], self.scores[full]


def first_of_each(queries: DataFrame) -> DataFrame:
    """Query rows that repeat an id count once, as the smallest vector."""
    return queries.groupBy("id").agg(F.min("vec").alias("vec"))
