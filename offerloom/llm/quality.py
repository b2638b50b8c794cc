"""Quality classifier: averaged embeddings of hashed word and character n-grams.

Features of a text are its words, its pairs of adjacent words and its runs of three and
five bytes, each hashed to a bucket. A pair's hash is the exclusive or of its words'
hashes, so that every word that follows itself falls into one bucket. A document is the
mean of its buckets' vectors, followed by a softmax; all is trained by stochastic
gradient descent in numpy, in one task, on a bounded sample of labelled rows.

The output is linear in the bucket vectors, so a trained model scores a text by the mean
of one number per feature: the vector's product with the difference of the class weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.llm.bytesview import Words, bytes_of, mixed
from offerloom.llm.common import crc_mod
from offerloom.llm.encode import slices

BUCKET_BITS = 17
#: Bound of the training sample, whose texts are read whole.
TRAIN_ROWS = 5_000
#: Text whose features are held at once: they take more than a hundred bytes for each of its own.
SLICE_BYTES = 512 << 10
_COUNTS = (np.uint8, np.uint16, np.int32)
THRESHOLD = 0.3


def features(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: bucket numbers in text order, and each text's bounds."""
    shift = np.uint64(64 - BUCKET_BITS)
    words = Words(data, bounds)
    h, edges = words.hashes, words.edges
    out = [((mixed(h + np.uint64(1)) >> shift).astype(np.int32), edges)]
    pairs = mixed((h[:-1] ^ h[1:]) + np.uint64(2)) >> shift
    # The pair that starts at a text's last word would reach into the next text.
    keep = np.ones(len(pairs), bool)
    cut = edges[1:-1] - 1
    keep[cut[(cut >= 0) & (cut < len(pairs))]] = False
    counts = np.maximum(np.diff(edges) - 1, 0)
    out.append((pairs[keep].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])))
    wide = data.astype(np.uint64)
    for n in (3, 5):
        if len(data) < n:
            out.append((np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)))
            continue
        grams = np.zeros(len(data) - n + 1, np.uint64)
        for j in range(n):
            grams = (grams << np.uint64(8)) | wide[j : len(data) - n + 1 + j]
        buckets = (mixed(grams + np.uint64(n << 48)) >> shift).astype(np.int32)
        lengths = np.maximum(np.diff(bounds) - n + 1, 0)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(bounds[:-1] - ends[:-1], lengths) + np.arange(ends[-1])
        out.append((buckets[at], ends))
    return out


@dataclass
class QualityModel:
    """One number per bucket and a constant; ``score`` is the softmax of class 1."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        data, bounds = bytes_of(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, edges in features(data, bounds):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
            total += sums[edges[1:]] - sums[edges[:-1]]
            count += np.diff(edges)
        logit = self.bias + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text, and how often each occurs."""
    raw = (text or "").encode()
    found = features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return np.unique(np.concatenate([b for b, _ in found]), return_counts=True)


def packed(found: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, int, bytes]:
    """A bag in 3 bytes a bucket for most texts, not 8: low 16 bits, how many are below 2 ** 16, and counts."""
    buckets, counts = found
    kind = next(k for k in _COUNTS if counts.max(initial=0) <= np.iinfo(k).max)
    low = int(np.searchsorted(buckets, 1 << 16))
    return buckets.astype(np.uint16).tobytes(), low, counts.astype(kind).tobytes()


def unpacked(low_bits: pa.Buffer, low: int, counts: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """The bag of which ``packed`` made this; the lengths tell the type of the counts."""
    buckets = np.frombuffer(low_bits, np.uint16).astype(np.int32)
    buckets[low:] += 1 << 16
    kind = next(k for k in _COUNTS if np.dtype(k).itemsize * len(buckets) == len(counts))
    return buckets, np.frombuffer(counts, kind).astype(np.int32)


class PackedBags(Sequence):
    """Bags that stay packed in the batches they came in, and are unpacked one at a time."""

    def __init__(self):
        self.parts: list[tuple[pa.Buffer, int, pa.Buffer]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        columns = (batch.column(name) for name in ("buckets", "low", "counts"))
        self.parts.extend((b.as_buffer(), low.as_py(), c.as_buffer()) for b, low, c in zip(*columns))

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return unpacked(*self.parts[i])


def train(
    bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: list[int], dim: int = 8, epochs: int = 12, rate: float = 4.0,
    seed: int = 7,
) -> QualityModel:
    """Fit bucket vectors and softmax weights; without two classes, a constant answer."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        sure = 4.0 if not len(y) or y[0] == 1 else -4.0
        return QualityModel(np.zeros(1 << BUCKET_BITS, np.float32), sure)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    out[:, 1] = rng.uniform(-0.5, 0.5, dim)
    bias[1] = np.log((y == 1).sum() / (y == 0).sum())
    epochs = max(epochs, -(-800 * 32 // len(y)))
    steps = epochs * -(-len(y) // 32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 32):
            now = rate * (1 - step / steps)
            step += 1
            held = {i: bags[i] for i in order[at : at + 32]}
            full = [i for i in held if len(held[i][0])]
            if not full:
                continue
            ids = np.concatenate([held[i][0] for i in full])
            sizes = np.array([len(held[i][0]) for i in full])
            share = np.concatenate([held[i][1] / held[i][1].sum() for i in full]).astype(np.float32)
            hidden = np.add.reduceat(table[ids] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
            logits = hidden @ out + bias
            logits -= logits.max(axis=1, keepdims=True)
            odds = np.exp(logits)
            odds /= odds.sum(axis=1, keepdims=True)
            odds[np.arange(len(full)), y[full]] -= 1
            back = (odds @ out.T) * now
            out -= 0.1 * now * hidden.T @ odds / len(full)
            bias -= 0.02 * now * odds.sum(axis=0) / len(full)
            change = np.repeat(back, sizes, axis=0) * share[:, None]
            order_ids = np.argsort(ids, kind="stable")
            same = np.flatnonzero(np.concatenate([[True], np.diff(ids[order_ids]) > 0]))
            table[ids[order_ids][same]] -= np.add.reduceat(change[order_ids], same, axis=0)
    slope = out[:, 1] - out[:, 0]
    return QualityModel((table @ slope).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, quality, text)`` of at most ``rows`` labelled documents, by a hash order.

    Only ids whose crc32 mod 5 is not 0 take part. Ids are chosen from the narrow table first; a
    doc_id with several labels counts as the lower one, with several texts as the
    smallest. Null ids and labels take no part.
    """
    ids = labels.where(F.col("quality").isin(0, 1) & (crc_mod("doc_id", 5) != 0))
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` ids: bounded by the parameter.
    found = docs.select(F.col("doc_id").alias("own_id"), "text")
    found = found.join(F.broadcast(ids), F.col("own_id") == F.col("doc_id"))
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Bags are made where texts lie, one of at most 2 ** BUCKET_BITS buckets for each document.

    One task meets the at most ``rows`` bags in the order of their ids and trains; the driver
    gets one number per bucket, whatever the texts hold. Bags move and wait packed, and tasks that
    make them hold those of ``SLICE_BYTES`` of text at a time.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = zip(*(packed(bag(text.as_py())) for text in part.column("text")))
                columns = [pa.array(x, kind) for x, kind in zip(found, (pa.binary(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality"), *columns],
                    names=["doc_id", "quality", "buckets", "low", "counts"],
                )

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, truth = PackedBags(), []
        for batch in batches:
            bags.add(batch)
            truth.extend(batch.column("quality").to_pylist())
        model = train(bags, truth)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "bias": [float(model.bias)]})

    sample = labelled_sample(docs, labels, rows).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text"
    )
    bags = sample.mapInArrow(made, "doc_id long, quality int, buckets binary, low int, counts binary")
    found = bags.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learned, "weights binary, bias double").collect()
    # Without labelled rows there may be no task.
    return QualityModel(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"]) if found else train([], [])


def with_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Add ``quality_score`` (0 to 1) to every row; null and empty texts score alike.

    Columns of that name are replaced; all others pass through unchanged.
    """
    docs = docs.drop("quality_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                scores = model.score(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores)], names=[*part.schema.names, "quality_score"]
                )
                # Arrow keeps what it took; a worker that lives long gives it back.
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(score, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    scored = with_quality(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
