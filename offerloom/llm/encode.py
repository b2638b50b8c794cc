"""Token ids of whole texts, with one library call per distinct chunk.

A text is cut at its spaces. Both public tokenizers cut a text into pieces before
they look at it, and no piece reaches over a cut made there, so a chunk has the same
ids alone as inside its text. Equal chunks of a batch are encoded once, and a memo of
bounded entries and lengths keeps them for later batches. Markers such as ``<|endoftext|>``
get the ids that the library gives them; they hold no spaces and take none with them.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Marks that form one piece of their own after a word; the apostrophe may not.
_TAIL = ".,!?;:|&$%*#@+-=_/()<>"
MEMO_ENTRIES = 600_000
#: Longer chunks are encoded anew in every batch.
MEMO_CHARS = 256
BATCH_BYTES = 4 << 20


class ChunkEncoder:
    """Ids as unsigned 16-bit numbers; the vocabularies used have fewer than 65,536.

    ``keeps_spaces`` says that a space belongs to the piece after it. Otherwise
    white space is dropped by the tokenizer and every cut at a space is safe.
    """

    def __init__(self, path: str, keeps_spaces: bool, memo_entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.keeps_spaces = keeps_spaces
        self.memo: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.memo_entries = memo_entries
        # Byte-level vocabularies show a printable byte as itself, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.table = {b: chr(256 + n) for n, b in enumerate(hidden)}

    def plain(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.uint16)

    def _learn(self, chunks: list[str]) -> None:
        """Put the ids of new chunks into the memo.

        Letters of Latin-1 with marks after them are cut by the tokenizer just there, so
        they go to its merge model directly; all else takes the whole way.
        """
        memo, tails = self.memo, self.tails
        tokenize, table = self.tokenizer.model.tokenize, self.table
        for chunk in chunks:
            core = chunk.rstrip(_TAIL)
            if core.isalpha() and (core.isascii() or max(core) <= "\xff"):
                ids = memo.get(core)
                if ids is None:
                    shown = core if self.keeps_spaces else core.lower()
                    if not shown.isascii():
                        shown = shown.encode().decode("latin-1").translate(table)
                    found = tokenize("\u0120" + shown if self.keeps_spaces else shown)
                    ids = memo[core] = array("H", [t.id for t in found]).tobytes()
                if len(core) < len(chunk):
                    tail = chunk[len(core) :]
                    known = tails.get(tail)
                    if known is None:
                        known = self.plain(tail).tobytes()
                        if len(tail) <= MEMO_CHARS:
                            tails[tail] = known
                    memo[chunk] = ids + known
            else:
                memo[chunk] = self.plain(" " + chunk if self.keeps_spaces else chunk).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text starts (one more at the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        if self.keeps_spaces:
            # A space before other white space may belong to one piece with it.
            odd = pc.match_substring_regex(texts, r" [\s\x1c-\x1f\x{85}\x{a0}\x0b\p{Z}]")
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                whole[i] = True
        pieces = pc.split_pattern(texts, " ")
        flat = pieces.flatten()
        edges = np.asarray(pieces.offsets, np.int64) - pieces.offsets[0].as_py()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # With the space kept, the first chunk of a text is the one without a space.
        blobs = list(map(self.memo.get, words))
        new = [w for w, blob in zip(words, blobs) if blob is None]
        if new:
            if len(self.memo) + len(new) > self.memo_entries:
                # What this batch holds stays and need not be learned again.
                self.memo = {w: blob for w, blob in zip(words, blobs) if blob is not None}
                self.tails.clear()
            self._learn(new)
            blobs = [self.memo[w] if blob is None else blob for w, blob in zip(words, blobs)]
            for word in new:
                if len(word) > MEMO_CHARS:
                    self.memo.pop(word, None)
                    self.memo.pop(word.rstrip(_TAIL), None)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2
        pool = np.frombuffer(b"".join(blobs), np.uint16)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        if self.keeps_spaces:
            pool, begins, sizes, codes = self._first_chunks(
                texts, whole, edges, codes, words, pool, begins, sizes
            )
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(begins[codes] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[edges]
        # Arrow keeps what a batch of pieces took; a worker that lives long gives it back.
        del texts, pieces, flat, coded
        pa.default_memory_pool().release_unused()
        return ids, bounds

    def _first_chunks(self, texts, whole, edges, codes, words, pool, begins, sizes):
        """Replace each text's first chunk, and all chunks of a text that cannot be cut."""
        codes = codes.copy()
        extra, extra_sizes, known = [], [], {}
        blank = len(sizes)
        for i in range(len(texts)):
            a, b = edges[i], edges[i + 1]
            chunk = texts[i].as_py() if whole[i] else words[codes[a]]
            if whole[i]:
                codes[a:b] = blank
            if chunk not in known:
                known[chunk] = blank + 1 + len(extra)
                ids = self.plain(chunk)
                extra.append(ids)
                extra_sizes.append(len(ids))
            codes[a] = known[chunk]
        at = len(pool) + np.concatenate([[0, 0], np.cumsum(extra_sizes)[:-1]]).astype(np.int64)
        pool = np.concatenate([pool, *extra])
        return (
            pool,
            np.concatenate([begins, at]),
            np.concatenate([sizes, [0], extra_sizes]).astype(np.int64),
            codes,
        )


def encoder(path: str, keeps_spaces: bool) -> ChunkEncoder:
    """One encoder per worker process, whose memo outlives a task.

    Functions of this package are sent by value, so a task has no module of its own to
    keep it in.
    """
    held = vars(sys).setdefault("_chunk_encoders", {})
    if (path, keeps_spaces) not in held:
        held[path, keeps_spaces] = ChunkEncoder(path, keeps_spaces)
    return held[path, keeps_spaces]


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
