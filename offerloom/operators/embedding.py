"""Text to vectors through a pluggable model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A model takes texts and gives an [n, d] array. The factory runs once per task,
# so weights are loaded on the executor and never shipped with the plan.
Model = Callable[[Sequence[str]], np.ndarray]
ModelFactory = Callable[[], Model]

PHRASE_VECTORS = "phrase string, vector array<float>"


class HashingModel:
    """Deterministic stand-in: bytes of MD5 digests, centred and scaled to unit length."""

    def __init__(self, dims: int = 16):
        self.dims = dims

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        rows = np.empty((len(texts), self.dims))
        blocks = -(-self.dims // 16)
        for i, text in enumerate(texts):
            digest = b"".join(
                hashlib.md5((text if b == 0 else f"{b}:{text}").encode()).digest()
                for b in range(blocks)
            )
            rows[i] = np.frombuffer(digest[: self.dims], dtype=np.uint8) - 127.5
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def hashing_factory(dims: int = 16) -> ModelFactory:
    return lambda: HashingModel(dims)


def embed_phrases(
    phrases: DataFrame,
    factory: ModelFactory,
    phrase_col: str = "phrase",
    partitions: int | None = None,
) -> DataFrame:
    """Distinct phrases to ``(phrase, vector)``.

    Each phrase goes through the model once, however often it occurs; the
    ``distinct`` shuffle also spreads the inference evenly. ``partitions`` sets how
    many tasks run the model.
    """
    distinct = phrases.select(F.col(phrase_col).alias("phrase")).where("phrase is not null")
    distinct = distinct.distinct()
    if partitions:
        distinct = distinct.repartition(partitions, "phrase")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            model = model or factory()
            texts = batch.column(0)
            vectors = np.asarray(model(texts.to_pylist()), dtype=np.float32)
            offsets = np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([texts, lists], names=["phrase", "vector"])

    return distinct.mapInArrow(run, PHRASE_VECTORS)
