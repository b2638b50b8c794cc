"""Report files, one folder per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators.sizing import broadcast_if_small
from offerloom.session import cut_lineage

#: Reports up to this size are written by one task to one file.
FILE_BYTES = 64 << 20


def _write(rows: DataFrame, path: str) -> None:
    writer = rows.select("user_id", "line").write.mode("overwrite")
    # Only the users at hand are replaced, whatever the session's own setting.
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("user_id").text(path)


def write_reports(lines: DataFrame, path: str, order: list[str], file_bytes: int = FILE_BYTES) -> None:
    """Write ``line`` texts in ``order`` below ``path/user_id=...``.

    A report of at most ``file_bytes`` is one file. Larger ones are range-partitioned by user
    and order, over several part files whose names sort in reading order. Files appear when a
    write commits, so one that breaks off leaves the reports as they were.
    """
    size = F.sum(F.octet_length("line") + 1)
    large = lines.groupBy("user_id").agg(size.alias("bytes")).where(F.col("bytes") > file_bytes)
    large = cut_lineage(large)
    files = large.agg(F.sum(F.ceil(F.col("bytes") / file_bytes))).first()[0]
    # Whoever is large holds file_bytes of all lines at least, which bounds their number.
    large = broadcast_if_small(large.select("user_id"), text_cols=("user_id",))
    whole = lines.join(large, "user_id", "left_anti").repartition("user_id")
    _write(whole.sortWithinPartitions("user_id", *order), path)
    if files:
        parts = lines.join(large, "user_id", "left_semi").repartitionByRange(int(files), "user_id", *order)
        _write(parts.sortWithinPartitions("user_id", *order), path)


def read_report(spark, path: str, user_id: str) -> DataFrame:
    """Lines of one user's report with the file they came from."""
    escaped = f"{path}/user_id={user_id}"
    return spark.read.text(escaped).select(
        F.input_file_name().alias("file"), F.col("value").alias("line")
    )
