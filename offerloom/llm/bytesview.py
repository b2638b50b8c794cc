"""Words, byte n-grams and their hashes over whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text starts (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Word hashes of many texts: ``hashes`` in text order, ``edges`` per text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        solid = ~_SPACE[data]
        starts_text = np.zeros(len(data) + 1, bool)
        starts_text[bounds] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | starts_text[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | starts_text[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        powers = _powers(_BASE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * powers[:-1], out=sums[1:])
        back = _powers(_INVERSE, len(data))
        self.hashes = mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
        self.edges = np.searchsorted(begin, bounds)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and where each text's runs start.

    A text with fewer words has one run of all its words; one without words has none.
    """
    h, edges = words.hashes, words.edges
    counts = np.diff(edges)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(bounds[-1], np.uint64)
    long = counts >= k
    if len(h) >= k:
        whole = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            whole = mixed(whole * np.uint64(31) + h[j : len(h) - k + 1 + j])
        at = np.repeat(edges[:-1][long] - bounds[:-1][long], runs[long])
        places = np.flatnonzero(np.repeat(long, runs))
        out[places] = whole[places + at]
    for i in np.flatnonzero((counts > 0) & ~long):
        part = np.full(1, counts[i], np.uint64)
        for x in h[edges[i] : edges[i + 1]]:
            part = mixed(part * np.uint64(31) + x)
        out[bounds[i]] = part[0]
    return out, bounds
