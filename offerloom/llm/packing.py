"""Best-fit packing of token sequences in supersteps over length classes.

Documents of one length are interchangeable, and so are sequences with one gap. A
superstep takes all documents of one length, longest first: they are matched to the
smallest gaps that hold them (the successors of their length among the sorted gaps),
a document's rank inside its length decides which gap it gets, and the gaps are updated
before the next step. The sorted classes number at most ``capacity`` however large the
table is, so the sweep works on counts; ranking, matching and placing the documents are
Spark joins and windows that split every length into parts of bounded size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import staged
from offerloom.llm.encode import crc_of_ids, encoder, slices

CAPACITY = 2048
END_ID = 0
PART_ROWS = 50_000


def cut_documents(
    docs: DataFrame, tokenizer: str, keeps_spaces: bool, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of all rows.

    A null text is empty; each row gets the end id. Only rows longer than ``capacity`` are
    cut. Equal rows stay apart, each with its own pieces. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(tokenizer, keeps_spaces), np.array([END_ID], np.uint16)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = tool.encode(part.column("text"))
                rows = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.concatenate([ids[bounds[i] : bounds[i + 1]], end])
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        held = own[at : at + capacity]
                        row = (doc_id, piece, at, len(held), crc_of_ids(held))
                        rows.append((*row, held.tobytes()) if with_ids else row)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
                    )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(cut, schema)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements ``(length, rank_from, rank_to, first_sequence, per_sequence, offset)``.

    The document of rank r goes to sequence ``first + (r - from) // per`` at
    ``offset + (r - from) % per * length``.
    """
    gaps: list[int] = []  # sorted sizes of open gaps
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    placements, sequences = [], 0

    def put(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in open_at:
                bisect.insort(gaps, gap)
                open_at[gap] = []
            open_at[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank, at = counts[length], 0, bisect.bisect_left(gaps, length)
        taken: list[tuple[int, int, int]] = []  # updates held back until the step ends
        while left:
            fresh = at == len(gaps)
            gap = capacity if fresh else gaps[at]
            per = gap // length
            runs = [(sequences, -(-left // per))] if fresh else open_at.pop(gap)
            if fresh:
                sequences += runs[0][1]
            else:
                gaps.pop(at)
            for first, many in runs:
                full = min(many, left // per)
                if full:
                    placements.append((length, rank, rank + full * per, first, per, capacity - gap))
                    taken.append((gap - per * length, first, full))
                    rank, left = rank + full * per, left - full * per
                if full < many and left:
                    placements.append((length, rank, rank + left, first + full, left, capacity - gap))
                    taken.append((gap - left * length, first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < many:
                    taken.append((gap, first + full, many - full))
        for update in taken:
            put(*update)
    return placements


def place(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` should be a written table: it is read three times. ``keys`` order rows of one
    length; rows equal in them are told apart by their place in the window alone.
    """
    spark = pieces.sparkSession
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placements = plan_best_fit(sizes, capacity)
    plan = spark.createDataFrame(
        placements or [(0, 0, 0, 0, 1, 0)],
        "plan_length long, lo long, hi long, first long, per long, base long",
    )
    # A length that many rows share is ranked in parts, chosen by a hash of the keys.
    parts = 1 + max(sizes.values(), default=0) // part_rows
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    counted = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        F.col("length").alias("own_length"),
        F.col("part").alias("own_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
    )
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy(*keys)) - 1
    ranked = dealt.withColumn("in_part", rank).join(
        starts, (F.col("length") == F.col("own_length")) & (F.col("part") == F.col("own_part"))
    )
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("in_part"))
    # The plan holds classes, not documents: its size depends on the capacity alone.
    matched = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("plan_length"))
        & (F.col("rank") >= F.col("lo"))
        & (F.col("rank") < F.col("hi")),
    )
    within = F.col("rank") - F.col("lo")
    return matched.select(
        *pieces.columns,
        (F.col("first") + F.floor(within / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + within % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, keeps_spaces: bool, capacity: int = CAPACITY) -> DataFrame:
    """All pieces of all rows of ``docs`` with their places, without the ids."""
    pieces = staged(cut_documents(docs, tokenizer, keeps_spaces, capacity), "pieces")
    return place(pieces, ["doc_id", "piece", "length", "ids_crc32"], capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the ids of each packed sequence, from placed pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
