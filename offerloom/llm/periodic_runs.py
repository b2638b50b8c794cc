"""Maximal periodic runs of words, found by an online sparse dynamic programme over diagonals.

The diagonal of a lag L counts how many words up to the present one equal the word L
earlier. Reading a text from left to right, earlier occurrences of the present word open
diagonals or extend active ones; a diagonal whose next words differ ends, and if it is long
enough its run is emitted at once. Only active diagonals are stored.

Three rules keep the occurrences few and lose no run:

* A run of period L repeats each word of its first period at least three times, so a
  diagonal opens only where the words one and two lags ahead agree as well.
* Occurrences are those of ``GRAM`` words in a row for lags of ``GRAM`` and more, of two words
  in a row for smaller ones, and count only if there are four of them.
* Within an active diagonal of lag p that is long enough, longer lags with both ends inside it
  are passed over: runs of different smallest periods p < L share fewer than p + L words. A
  run that begins there and outlives the diagonal is met at the first word behind it, and
  its begin is found by reading back.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import WORD

#: Least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
GRAM = 8
#: A batch is passed on once it holds so many bytes of collapsed text.
FLUSH_BYTES = 4 << 20
#: Up to so many earlier occurrences are looked at one by one, more of them at once.
FEW = 24
_GAP = r"[\x20\x09-\x0D]+"


class _Grams:
    """Earlier places of the same ``width`` words in a row, for words named by numbers."""

    def __init__(self, names: np.ndarray, width: int):
        step = 1
        while step < width and len(names) > step:
            _, names = np.unique(names[:-step] * (names.max() + 1) + names[step:], return_inverse=True)
            step *= 2
        names = names if step >= width else names[:0]
        counts = np.bincount(names, minlength=1)
        self.common = np.flatnonzero(counts[names] >= LEAST_PERIODS)
        order = self.common[np.argsort(names[self.common], kind="stable")]
        edges = np.flatnonzero(np.diff(names[order])) + 1
        self.of = names.tolist()
        self.lists = {self.of[part[0]]: part.tolist() for part in np.split(order, edges) if len(part)}


def _long_enough(matches: int, lag: int) -> bool:
    return matches >= max(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of words named by numbers, in order.

    A run is a stretch that no neighbouring word extends at its smallest period, of at least
    ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words.
    """
    n = len(codes)
    pairs = _Grams(codes, 2)
    if n < LEAST_WORDS or not len(pairs.common):
        return []
    grams = _Grams(codes, GRAM)
    words = codes.tolist()
    frequent = np.zeros(n, np.bool_)
    frequent[pairs.common] = True
    long = np.zeros(n, np.bool_)
    long[grams.common] = True
    opening = pairs.common.tolist()
    active: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}

    def emit(lag: int, begin: int, end: int) -> None:
        if _long_enough(end - begin, lag):
            place = (begin - lag, end - begin + lag)
            found[place] = min(lag, found.get(place, lag))

    def openings(i: int) -> Iterator[int]:
        """Lags of earlier occurrences whose words one and two lags ahead agree."""
        # Spans of earlier places that an active run passes over.
        inside = [(begin - lag, i - lag) for lag, begin in active.items() if _long_enough(i - begin + 1, lag)]
        farthest = max(0, i - (n - 1 - i) // (LEAST_PERIODS - 2))
        for held, near, far in ((pairs, i - 1, i - GRAM + 1), (grams, i - GRAM, 0)):
            if held is grams and not long[i]:
                continue
            spans = [(max(far, farthest), near)]
            for since, until in inside:
                spans = [x for low, high in spans for x in ((low, min(high, since - 1)), (max(low, until), high))]
                spans = [(low, high) for low, high in spans if low <= high]
            for low, high in spans:
                own = held.lists[held.of[i]]
                a, b = bisect_left(own, low), bisect_left(own, high + 1)
                if b - a <= FEW:
                    for j in own[a:b]:
                        if words[2 * i - j] == words[i] and words[3 * i - 2 * j] == words[i]:
                            yield i - j
                else:
                    lags = i - np.array(own[a:b])
                    agree = (codes[i + lags] == codes[i]) & (codes[i + 2 * lags] == codes[i])
                    yield from lags[agree].tolist()

    i, at = 0, 0
    while i < n:
        if not active:
            at = bisect_left(opening, i, at)
            if at == len(opening):
                break
            i = opening[at]
        for lag in [x for x in active if words[i] != words[i - x]]:
            emit(lag, active.pop(lag), i)
        if frequent[i]:
            for lag in openings(i):
                if lag not in active:
                    begin = i
                    while begin > lag and words[begin - 1] == words[begin - 1 - lag]:
                        begin -= 1
                    active[lag] = begin
        i += 1
    for lag, begin in active.items():
        emit(lag, begin, n)
    return sorted((start, length, period) for (start, length), period in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def with_runs(docs: DataFrame) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of ``(id, text)`` rows.

    Words are what ASCII white space separates; ``runs`` are structs ``(start, length, period)``
    counted in words, by start, then period. ``collapsed`` holds the kept words, joined by one
    space. A null or empty text has no words, no runs and an empty collapsed text. Each text is
    read in one task, in memory that grows with its own words; nothing is shuffled.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = [], []

            def flush() -> pa.RecordBatch:
                counts, runs, texts = zip(*held)
                made = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
                return pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(ids), pa.array(counts, pa.int64()), pa.array(made, pa.list_(run)), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )

            size, texts = 0, batch.column("text").cast(pa.large_binary())
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                names: dict[bytes, int] = {}
                codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
                runs = runs_of(codes)
                if runs:
                    words = [words[j] for j in np.flatnonzero(kept_words(len(words), runs))]
                ids.append(batch.column("id").slice(i, 1))
                held.append((len(codes), runs, b" ".join(words)))
                size += len(held[-1][2])
                if size > FLUSH_BYTES:
                    yield flush()
                    size = 0
                    ids.clear()
                    held.clear()
            if held:
                yield flush()

    shape = "array<struct<start: long, length: long, period: long>>"
    return docs.select("id", "text").mapInArrow(rows, f"id long, n_words long, runs {shape}, collapsed string")


def strongest(runs: str) -> Column:
    """The run with the greatest exact length / period; of equals the first; null without runs."""
    rest = F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1)))
    better = F.aggregate(
        rest, F.get(F.col(runs), F.lit(0)),
        lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a),
    )
    return better


def repeating(docs: DataFrame) -> DataFrame:
    """``(id, text)``: of one document in ten, by a hash of its id, the words repeat from some
    word on with some period; the others, and rows without an id, keep their text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", _GAP), "")
    made = docs.select(
        F.col("doc_id").cast("bigint").alias("id"), "text", g.alias("g"),
        F.when((h % 10 == 0) & F.col("text").rlike(WORD), words).alias("words"),
    )
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    made = made.select("id", "text", "words", F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    again = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))),
    )
    return made.select("id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(again, " ")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_runs``, its strongest run and digests of all runs and
    of the collapsed text; the words of one document in ten are made periodic first.

    ``exponent_milli`` is floor(1000 * length / period). Without runs the four numbers of the
    strongest run are null. Repeated rows have equal rows; other columns are ignored; an
    empty table gives no rows.
    """
    found = with_runs(repeating(docs)).select("*", strongest("runs").alias("best"))
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
