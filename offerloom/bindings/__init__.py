"""The operators bound to the driver's tables, each next to its check in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from offerloom.sources.records import spread_scan


class Bound(NamedTuple):
    """A query on a folder of Parquet tables and, where SQL can say it, its check."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are costly to process, spread over all cores."""
    return spread_scan(table(spark, folder, name))


def all_bound() -> dict[str, Bound]:
    from offerloom.bindings import cleaning, exploring, matching, pages, storing, texts

    merged: dict[str, Bound] = {}
    for module in (matching, texts, cleaning, pages, storing, exploring):
        merged.update(module.QUERIES)
    return merged
