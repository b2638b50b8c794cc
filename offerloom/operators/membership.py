"""A Bloom filter of a column's values, built by aggregation and carried as a literal."""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each value, and the bounds of the filter as powers of two. Beyond the larger one
#: more strangers pass; no member is ever refused.
BITS_PER_VALUE = 16
LEAST_BITS, MOST_BITS = 10, 23


class MemberBits(NamedTuple):
    """``words`` holds 64 bits each, ``1 << log2`` in all."""

    log2: int
    words: list[int]


def member_hash(value: Column) -> Column:
    return F.xxhash64(value)


def _places(h: Column, log2: int) -> tuple[Column, Column]:
    """The two bits of a value, from both halves of its hash."""
    mask = F.lit((1 << log2) - 1)
    return h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)


def member_bits(values: DataFrame, name: str, hashed: bool = False) -> MemberBits:
    """The filter of all values of a column; nulls are no members.

    With ``hashed`` the column holds hashes of the values, as ``holds`` takes them.

    Bits are combined in the map tasks, and at most ``2 ** (MOST_BITS - 6)`` words reach the
    driver, whatever the number of values.
    """
    column = F.col(name)
    about = values.agg(F.approx_count_distinct(column)).first()[0]
    log2 = min(max((about * BITS_PER_VALUE).bit_length(), LEAST_BITS), MOST_BITS)
    bits = values.where(column.isNotNull()).select(F.explode(F.array(*_places(column if hashed else member_hash(column), log2))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    rows = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    words = [0] * (1 << (log2 - 6))
    for r in rows:
        words[r["word"]] = r["bits"]
    return MemberBits(log2, words)


def may_hold(h: Column, members: MemberBits) -> Column:
    """By a value's ``member_hash``: false for what is certainly no member, true for every member."""
    # Folded to one constant array when the query is planned.
    words = F.from_json(F.lit(json.dumps(members.words)), "array<bigint>")

    def is_set(bit: Column) -> Column:
        word = F.get(words, F.shiftright(bit, 6).cast("int"))
        return F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1

    first, second = _places(h, members.log2)
    return is_set(first) & is_set(second)


def bit_table(members: MemberBits) -> np.ndarray:
    """The filter with one byte a bit, as ``holds`` takes it."""
    return np.unpackbits(np.array(members.words, np.int64).view(np.uint8), bitorder="little").view(bool)


def holds(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``may_hold`` for unsigned hashes in an array."""
    mask = np.uint64(len(table) - 1)
    out = table[(h & mask).view(np.int64)]
    at = np.flatnonzero(out)
    out[at] = table[(h[at] >> np.uint64(32) & mask).view(np.int64)]
    return out
