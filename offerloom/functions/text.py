"""Text tests and literal parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of letters, digits and underscores; Java's \w would be ASCII only.
TOKEN_PATTERN = r"([\p{L}\p{N}_]+)"


def contains_ci(col: Column, needle: str) -> Column:
    """Case-insensitive substring test; null counts as no."""
    return F.coalesce(F.contains(F.lower(col), F.lit(needle.lower())), F.lit(False))


def any_contains_ci(cols: Iterable[Column], needle: str) -> Column:
    result = F.lit(False)
    for col in cols:
        result = result | contains_ci(col, needle)
    return result


def is_remote(description: Column, vacancy_name: Column) -> Column:
    return any_contains_ci([description, vacancy_name], "remote")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(1))


def parse_bool(text: Column) -> Column:
    """``"True"``/``"False"`` to boolean, anything else to null."""
    return F.when(F.trim(text) == "True", F.lit(True)).when(F.trim(text) == "False", F.lit(False))


def parse_number(text: Column) -> Column:
    return text.try_cast("double")


def parse_count(text: Column) -> Column:
    """Count with thousands separators; missing or unreadable text is 0."""
    return F.coalesce(F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("int"), F.lit(0))


def squeeze(text: Column) -> Column:
    """Strip white space, line breaks included, from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
