"""Dated snapshots: write one, list them, read the latest valid one."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.sources.listing import names_in
from offerloom.sources.records import empty, read_table

DATE_COL = "snapshot_date"


def snapshot_day(text: Column) -> Column:
    """Snapshot name to date; a name that is no ``yyyy-MM-dd`` date gives null."""
    shaped = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), text)
    return shaped.try_cast("date")


def latest_day(df: DataFrame, name_col: str = DATE_COL) -> DataFrame:
    """One row with the newest valid snapshot date, null when there is none."""
    return df.agg(F.max(snapshot_day(F.col(name_col))).alias("latest"))


def latest_rows(df: DataFrame, name_col: str = DATE_COL) -> DataFrame:
    """Rows of the newest valid snapshot.

    For tables whose snapshots are no folders: the date takes a pass over ``name_col``, the
    rows another. ``read_latest`` only lists folders.
    """
    newest = F.date_format(latest_day(df, name_col).scalar(), "yyyy-MM-dd")
    return df.where(F.col(name_col) == newest)


def snapshot_dates(df: DataFrame, name_col: str = DATE_COL) -> DataFrame:
    """Valid snapshot dates present in a table."""
    days = df.select(snapshot_day(F.col(name_col)).alias(DATE_COL)).distinct()
    return days.where(F.col(DATE_COL).isNotNull())


def _with_name(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(DATE_COL, T.StringType())])


def read_snapshots(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All snapshots with their names as text; nothing there gives an empty table."""
    return read_table(spark, root, _with_name(schema))


def latest_folder(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest valid snapshot, from a listing alone; none before the first run."""
    days = []
    for name in names_in(spark, root):
        key, _, day = name.partition("=")
        if key == DATE_COL and re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
            try:
                days.append(date.fromisoformat(day))
            except ValueError:
                continue
    return f"{root.rstrip('/')}/{DATE_COL}={max(days).isoformat()}" if days else None


def read_latest(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The newest snapshot in ``schema``, empty before the first run; no other one is opened."""
    folder = latest_folder(spark, root)
    return empty(spark, schema) if folder is None else read_table(spark, folder, schema)


def write_snapshot(df: DataFrame, root: str, day: date) -> None:
    """Write one dated snapshot; only this date's folder is replaced."""
    (
        df.withColumn(DATE_COL, F.lit(day.isoformat()))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATE_COL)
        .parquet(root)
    )


def replace_snapshot(df: DataFrame, root: str, day: date) -> None:
    """Like ``write_snapshot``, but no rows replace this date's rows as well."""
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{DATE_COL}={day.isoformat()}")


def list_files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """``(path, length)`` of all files below ``root`` whose path ends in ``suffix``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    )
    listed = files.select("path", "length")
    return listed.where(F.endswith("path", F.lit(suffix))) if suffix else listed


def dated_folders(files: DataFrame) -> DataFrame:
    """Folder names (the last one before the file) of listed files."""
    parts = F.split("path", "/")
    return files.select(F.get(parts, F.size(parts) - 2).alias(DATE_COL)).distinct()
