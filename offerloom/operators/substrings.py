"""Substrings of texts that may stand in a set, found with numpy inside the scan's tasks.

Texts are taken as their UTF-8 bytes, in which a substring of characters is one of bytes and
the other way round. The hash of any stretch follows from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators.membership import bit_table, holds, member_bits

#: Members longer than this many bytes are looked for only where these first bytes may begin one.
FIRST = 6
#: Places looked at together: few enough for a processor's cache, whatever the lengths of texts.
WINDOW = 1 << 16
#: Texts whose lists leave a task together.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_WRAP = 1 << 64


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text starts (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Sums:
    """Hashes of the stretches of some bytes."""

    def __init__(self, data: np.ndarray, powers: np.ndarray, back: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])
        self.back = back

    def hashes(self, begin: np.ndarray | slice, size: int | np.ndarray) -> np.ndarray:
        """Of the stretches of ``size`` bytes from ``begin`` on; a slice starts at its first place."""
        if isinstance(begin, slice):
            h = self.sums[size : begin.stop + size] - self.sums[begin]
        else:
            h = self.sums[begin + size] - self.sums[begin]
        h *= self.back[begin]
        h += np.asarray(size).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n, _BASE), _powers(n, pow(_BASE, -1, _WRAP))


def member_hashes(members: DataFrame, name: str) -> DataFrame:
    """``(first, whole, size)`` of all members: hashes of their first bytes, null where these are
    all, and of the whole, and their number of bytes. The empty member is left out."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                data, bounds = _flat(batch.column("member").slice(at, 1_000))
                sums, sizes = _Sums(data, *_tables(len(data))), np.diff(bounds)
                first = sums.hashes(bounds[:-1], np.minimum(sizes, FIRST)).view(np.int64)
                whole = sums.hashes(bounds[:-1], sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first, mask=sizes <= FIRST), pa.array(whole), pa.array(sizes)], names=["first", "whole", "size"]
                )

    named = members.where(F.length(name) > 0).select(F.col(name).alias("member"))
    return named.mapInArrow(hashed, "first long, whole long, size long")


def _found(data: np.ndarray, bounds: np.ndarray, sizes: list[int], first: np.ndarray, whole: np.ndarray) -> Iterator[tuple]:
    """``(text, begin, size)`` arrays of the places of members; in a window each member once for a text."""
    powers, back = _tables(min(len(data), WINDOW + max(sizes)))
    for base in range(0, len(data), WINDOW):
        part = data[base : base + WINDOW + max(sizes)]
        sums, found = _Sums(part, powers, back), []
        begins = None
        for size in sizes:
            if size > FIRST and begins is None:
                every = slice(0, max(0, min(WINDOW, len(part) - FIRST + 1)))
                begins = np.flatnonzero(holds(sums.hashes(every, FIRST), first))
            if begins is None:
                every = slice(0, max(0, min(WINDOW, len(part) - size + 1)))
                h = sums.hashes(every, size)
                at = np.flatnonzero(holds(h, whole))
                found.append((at, h[at], size))
            else:
                at = begins[: np.searchsorted(begins, len(part) - size, "right")]
                h = sums.hashes(at, size)
                hit = holds(h, whole)
                found.append((at[hit], h[hit], size))
        at, h = np.concatenate([x[0] for x in found]) + base, np.concatenate([x[1] for x in found])
        size = np.repeat(np.array([x[2] for x in found], np.int64), [len(x[0]) for x in found])
        text = np.searchsorted(bounds, at, "right") - 1
        inside = np.flatnonzero(at + size <= bounds[text + 1])
        _, once = np.unique(h[inside] + text[inside].astype(np.uint64) * np.uint64(_BASE), return_index=True)
        once = inside[once]
        if len(once):
            yield text[once], at[once], size[once]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of text each, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def member_lists(texts: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """``(key, members)``: for each ``(key, text)`` its substrings that may be members, near to
    those that are. A substring may stand there more than once.

    Null texts are left out, and the empty member is in no list. The memory of a task depends on
    one text at most, not on the number of members.
    """
    hashes = member_hashes(members, name)
    sizes = sorted(r["size"] for r in hashes.select("size").distinct().collect())
    filters = [member_bits(hashes, column, hashed=True) for column in ("first", "whole")]
    kind = f"key {texts.schema['key'].dataType.simpleString()}, members array<binary>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole = [bit_table(f) for f in filters]
        none = np.zeros(0, np.int64)
        for batch in batches:
            for part in _slices(batch):
                data, bounds = _flat(part.column("text"))
                found = [(none, none, none), *(_found(data, bounds, sizes, first, whole) if sizes else ())]
                text, begin, size = [np.concatenate(x) for x in zip(*found)]
                order = np.argsort(text, kind="stable")
                begin, size = begin[order], size[order]
                ends = np.cumsum(size)
                held = data[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
                edges = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
                flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, edges, pa.py_buffer(held)])
                counts = np.cumsum([0, *np.bincount(text, minlength=part.num_rows)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(counts), flat.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=["key", "members"])

    shown = texts.where("text is not null").select("key", F.col("text").cast("binary").alias("text"))
    return shown.mapInArrow(search, kind).select("key", F.col("members").cast("array<string>").alias("members"))
