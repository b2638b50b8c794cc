"""Stable offer keys and composite match keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The DNS namespace of RFC 4122 and the public base-57 alphabet
# (digits and letters without 0, 1, I, O and l).
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"
BASE57 = "23456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
KEY_WIDTH = 22


def name_uuid_hex(name: Column) -> Column:
    """Version-5 UUID of ``name`` in the DNS namespace, as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    # RFC 4122: digit 13 is the version; the top two bits of digit 17 are 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 12),
        F.lit("5"),
        F.substring(digest, 14, 3),
        variant,
        F.substring(digest, 18, 15),
    )


def base57(hex128: Column) -> Column:
    """Write a 128-bit hex number in base 57, padded to 22 characters.

    Long division over four 32-bit limbs. Each step divides by 57 and keeps the
    remainder as the next digit, least significant first.
    """
    limbs = [
        F.conv(F.substring(hex128, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)
    ]
    start = F.struct(
        limbs[0].alias("a"),
        limbs[1].alias("b"),
        limbs[2].alias("c"),
        limbs[3].alias("d"),
        F.lit("").alias("text"),
    )

    def whole(x: Column) -> Column:
        return F.floor(x / F.lit(57.0)).cast("bigint")

    def step(acc: Column, _: Column) -> Column:
        # Remainders stay below 57, so every intermediate fits in 38 bits and the
        # double division inside ``whole`` is exact.
        shift = F.lit(1 << 32)
        rem_a = acc["a"] % 57
        cur_b = rem_a * shift + acc["b"]
        cur_c = (cur_b % 57) * shift + acc["c"]
        cur_d = (cur_c % 57) * shift + acc["d"]
        digit = (cur_d % 57).cast("int")
        return F.struct(
            whole(acc["a"]).alias("a"),
            whole(cur_b).alias("b"),
            whole(cur_c).alias("c"),
            whole(cur_d).alias("d"),
            F.concat(F.substring(F.lit(BASE57), digit + 1, F.lit(1)), acc["text"]).alias("text"),
        )

    steps = F.sequence(F.lit(1), F.lit(KEY_WIDTH))
    return F.aggregate(steps, start, step, lambda acc: acc["text"])


def stable_key(link: Column) -> Column:
    """Key of an offer: the same link always gives the same 22 characters."""
    return base57(name_uuid_hex(link))


def match_key(user_id: Column, job_id: Column) -> Column:
    return F.concat(user_id, F.lit("|"), job_id)


def split_match_key(match_id: Column) -> tuple[Column, Column]:
    parts = F.split(match_id, r"\|")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
