"""Language of a text by a convolutional network over bytes.

Bytes have learned vectors; filters of several widths slide over them, each filter keeps
its maximum in a window of fixed length, and a softmax layer reads the maxima. Windows
cover the whole text side by side, in batches, and a text's answer is the mean of its
windows' outputs, weighted by length. Trained in numpy on a bounded labelled sample.

A filter is a sum of one table look-up per byte place, so a trained model keeps its
filters as tables over bytes and byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.llm.bytesview import SLICE_BYTES, bytes_of
from offerloom.llm.common import crc_mod
from offerloom.llm.encode import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
PAD = max(WIDTHS)
#: Bounds of the training sample: rows of one language, rows in all, windows of one row.
TRAIN_ROWS_EACH = 400
TRAIN_ROWS = 4_000
TRAIN_WINDOWS = 3
#: Parts in which the rows of one language are ranked first; then one task ranks at most so many times TRAIN_ROWS_EACH.
RANK_PARTS = 64
UNKNOWN = "und"


@dataclass
class LanguageModel:
    names: list[str]
    embed: np.ndarray
    kernels: dict[int, np.ndarray]  # width -> (width, dim, filters)
    dense: np.ndarray
    bias: np.ndarray
    tables: dict = field(default_factory=dict)

    def _tables(self) -> dict:
        if not self.tables:
            for width, kernel in self.kernels.items():
                one = [(self.embed @ k).astype(np.float32) for k in kernel]
                pairs = []
                for o in range(0, width - 1, 2):
                    pairs.append((o, (one[o][:, None] + one[o + 1][None]).reshape(65536, -1)))
                last = [(width - 1, one[-1])] if width % 2 else []
                self.tables[width] = pairs, last
        return self.tables

    def outputs(self, texts: pa.Array) -> np.ndarray:
        """Mean output before the softmax of each text; zeros for texts without bytes."""
        data, bounds = bytes_of(texts)
        lengths = np.diff(bounds)
        padded = np.zeros(len(data) + PAD * (len(lengths) + 1), np.uint8)
        padded[np.arange(len(data)) + np.repeat(PAD * np.arange(len(lengths)), lengths)] = data
        begins = bounds[:-1] + PAD * np.arange(len(lengths))
        windows = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(lengths)), windows)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = begins[owner] + number * WINDOW
        sizes = np.minimum(WINDOW, lengths[owner] - number * WINDOW)
        total = np.zeros((len(lengths), len(self.names)))
        for at in range(0, len(starts), 512):
            logits = self._windows(padded, starts[at : at + 512], sizes[at : at + 512])
            np.add.at(total, owner[at : at + 512], logits * sizes[at : at + 512, None])
        return total / np.maximum(lengths, 1)[:, None]

    def _windows(self, padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Network outputs of windows that follow each other in ``padded``."""
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        codes = padded.astype(np.int32)[at[0] : at[-1] + PAD + 1]
        pairs, at = codes[:-1] * 256 + codes[1:], at - at[0]
        maxima = []
        for width, (doubles, singles) in self._tables().items():
            value = None
            for o, table in doubles:
                part = table[pairs[at + o]]
                value = part if value is None else np.add(value, part, out=value)
            for o, table in singles:
                value += table[codes[at + o]]
            maxima.append(np.maximum.reduceat(value, ends - sizes, axis=0))
        return np.maximum(np.concatenate(maxima, axis=1), 0) @ self.dense + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        logits = self.outputs(texts)
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        return np.array(self.names, object)[best], odds[np.arange(len(best)), best]


def spread_windows(text: str) -> list[bytes]:
    """At most ``TRAIN_WINDOWS`` windows, from places spread over the whole text."""
    raw = text.encode()
    places = range(0, len(raw), WINDOW)
    return [raw[at : at + WINDOW] for at in places[:: max(1, len(places) // TRAIN_WINDOWS)][:TRAIN_WINDOWS]]


def train(
    windows: list[bytes], langs: list[str], dim: int = 8, filters: int = 8, epochs: int = 5, seed: int = 11
) -> LanguageModel | None:
    """Fit the network by Adam on mini-batches; ``None`` where there is nothing to learn."""
    names = sorted(set(langs))
    if not names:
        return None
    x = np.array([np.frombuffer(w.ljust(WINDOW + PAD, b"\0"), np.uint8) for w in windows])
    sizes = np.array([len(w) for w in windows])
    y = np.array([names.index(lang) for lang in langs])
    rng = np.random.default_rng(seed)
    parts = {"embed": rng.normal(0, 0.5, (256, dim))}
    for width in WIDTHS:
        parts[f"k{width}"] = rng.normal(0, 1 / np.sqrt(width * dim), (width, dim, filters))
    parts["dense"] = rng.normal(0, 0.2, (filters * len(WIDTHS), len(names)))
    parts["bias"] = np.zeros(len(names))
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    step, lanes = 0, np.arange(filters)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            xs, n = x[pick].astype(np.int64), len(pick)
            beyond = np.arange(WINDOW)[None] >= sizes[pick][:, None]
            feats, where = [], {}
            for width in WIDTHS:
                value = 0
                for o in range(width):
                    value = value + (parts["embed"] @ parts[f"k{width}"][o])[xs[:, o : o + WINDOW]]
                value[beyond] = -np.inf
                where[width] = value.argmax(axis=1)
                feats.append(np.take_along_axis(value, where[width][:, None], 1)[:, 0])
            raw = np.concatenate(feats, axis=1)
            hidden = np.maximum(raw, 0)
            logits = hidden @ parts["dense"] + parts["bias"]
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            odds[np.arange(n), y[pick]] -= 1
            odds /= n
            grads = {"dense": hidden.T @ odds, "bias": odds.sum(axis=0), "embed": np.zeros((256, dim))}
            back = (odds @ parts["dense"].T) * (raw > 0)
            for w, width in enumerate(WIDTHS):
                kernel, own = parts[f"k{width}"], back[:, w * filters : (w + 1) * filters]
                grad = np.zeros_like(kernel)
                for o in range(width):
                    seen = xs[np.arange(n)[:, None], where[width] + o]
                    grad[o] = np.einsum("nfd,nf->df", parts["embed"][seen], own)
                    np.add.at(grads["embed"], seen, kernel[o].T[lanes][None] * own[..., None])
                grads[f"k{width}"] = grad
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                parts[k] -= 0.01 * move
    kernels = {width: parts[f"k{width}"] for width in WIDTHS}
    return LanguageModel(names, parts["embed"], kernels, parts["dense"], parts["bias"])


def labelled_sample(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, text)`` of a bounded sample: rows with a lang and crc32(doc_id) mod 3 other than 1.

    Chosen by a hash of the id on narrow rows, so many of each language and so many in all;
    texts are fetched for the chosen rows only. A repeated id counts once, as its smallest
    lang and text. Rows without id or text take no part.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 3) != 1))
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    # By scan task, as each task sends on no more than the first of a language and a part.
    ids = ids.withColumn("part", F.spark_partition_id() % RANK_PARTS)
    # The first of a language are among the first of its parts: no task ranks a whole language.
    for keys in (("lang", "part"), ("lang",)):
        order = Window.partitionBy(*keys).orderBy("hash", "doc_id")
        ids = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TRAIN_ROWS_EACH)
    ids = ids.orderBy("rank", "lang").limit(TRAIN_ROWS)
    ids = ids.select(F.col("doc_id").alias("own_id")).distinct()
    # At most TRAIN_ROWS ids: bounded by the parameter.
    found = usable.join(F.broadcast(ids), F.col("doc_id") == F.col("own_id"), "left_semi")
    found = found.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "one.lang", "one.text")


def fit(docs: DataFrame) -> LanguageModel | None:
    """Windows are cut where texts lie; the driver gets at most ``TRAIN_WINDOWS`` of each row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spread_windows(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.list_(pa.binary()))],
                names=["doc_id", "lang", "windows"],
            )

    rows = labelled_sample(docs).mapInArrow(cut, "doc_id long, lang string, windows array<binary>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    pairs = [(bytes(w), r["lang"]) for r in rows for w in r["windows"]]
    return train([w for w, _ in pairs], [lang for _, lang in pairs])


def with_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` to every row.

    A null text, a text without a letter, or no model gives ``und`` and 0. Columns of
    these names are replaced; all others pass through unchanged.
    """
    docs = docs.drop("lang_pred", "lang_score")
    flag = "has_letter"
    while flag in docs.columns:
        flag = f"_{flag}"
    docs = docs.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                known = part.column(flag).to_numpy(zero_copy_only=False).astype(bool)
                names, scores = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
                if model is not None and part.num_rows:
                    found, odds = model.predict(part.column("text"))
                    names[known], scores[known] = found[known], odds[known]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores)],
                    names=[*part.schema.names, "lang_pred", "lang_score"],
                )

    return docs.mapInArrow(guess, schema).drop(flag)


def language_answers(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row."""
    model = fit(docs)
    return with_language(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )
