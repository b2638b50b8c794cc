"""Landing-folder ingest: new raw offers are keyed, deduplicated and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerloom.functions.keys import stable_key
from offerloom.functions.text import is_remote
from offerloom.operators.dedupe import keep_first, row_hash
from offerloom.schemas import RAW_OFFERS

BATCH = "batch_id"


def landing_stream(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Raw offers as they land, one JSON record per line."""
    reader = spark.readStream.schema(RAW_OFFERS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def keyed(raw: DataFrame) -> DataFrame:
    """Scalar part of the enrichment; unusable rows are left out."""
    good = raw.where("link is not null and description is not null")
    return good.withColumns(
        {
            "job_id": stable_key(F.col("link")),
            "remote": is_remote(F.col("description"), F.col("vacancy_name")),
        }
    )


def first_in_window(
    stream: DataFrame, key: str, event_time: str, delay: str = "7 days"
) -> DataFrame:
    """Drop repeats of a key while its first row is within the watermark delay.

    State is kept per key and leaves with the watermark, so it stays bounded by the
    keys of one delay.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def append_log(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append each micro-batch to a log table under its batch number.

    A batch that is retried after a failure replaces its own folder, so the log
    holds each batch exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BATCH)
            .parquet(path)
        )

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_rows(log: DataFrame, key: str = "job_id") -> DataFrame:
    """The newest version of each key in the log: the upsert, done when reading."""
    content = log.drop(BATCH)
    return keep_first(log, [key], [F.desc(BATCH), row_hash(content)]).drop(BATCH)
