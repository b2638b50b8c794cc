"""A stream merged into a versioned table of current rows, with expiry and late rows aside.

Every micro-batch publishes one version (``sources.versions``) of three kinds of entries:

* ``current``: the newest row of each key that is not older than the watermark. Only this part
  is read and rewritten by the next batch, so its size is that of one delay, not of the log.
* ``expired/<batch>``: rows that the watermark passed in that batch. A key that comes back
  later starts anew.
* ``late/<batch>``: rows that were older than the watermark when they came.

The watermark is the newest event time of all batches before, less the delay. It is published
with the version, so that a batch that is retried meets the same one and changes nothing if
it was published already.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerloom.operators.dedupe import keep_first, row_hash
from offerloom.sources.versions import Version, commit, read_entries, read_manifest

_BATCH, _NEWEST = "batch", "newest_micros"
_EPOCH = datetime(1970, 1, 1)


def _micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def merge_batch(
    batch: DataFrame, batch_id: int, root: str, key: str, event_time: str, delay: timedelta
) -> int:
    """Merge one micro-batch and publish it; the number of the version that holds it.

    Of the rows of a key the newest stays, of equally new ones one by a hash of its content.
    Rows without an event time or key are late ones. A batch published before is left alone.
    """
    spark, schema = batch.sparkSession, batch.schema

    def done(version: Version) -> bool:
        return version.notes.get(_BATCH, -1) >= batch_id

    last = read_manifest(spark, root)
    if done(last):
        return last.number
    wait = delay // timedelta(microseconds=1)
    seen = last.notes.get(_NEWEST)
    batch = batch.persist()
    try:
        at = _micros(event_time)
        newest = batch.agg(F.max(at)).first()[0]
        newest = max((x for x in (seen, newest) if x is not None), default=None)
        usable = F.col(key).isNotNull() & at.isNotNull()
        if seen is not None:
            usable = usable & (at >= seen - wait)
        usable = F.coalesce(usable, F.lit(False))
        rows = read_entries(spark, root, schema, "current", last).unionByName(batch.where(usable))
        merged = keep_first(rows, [key], [F.desc(event_time), row_hash(rows)]).persist()
        live = F.lit(True) if newest is None else at >= newest - wait
        put = {
            "current": merged.where(live),
            f"expired/{batch_id:012d}": merged.where(~live),
            f"late/{batch_id:012d}": batch.where(~usable),
        }
        try:
            return commit(spark, root, put, notes={_BATCH: batch_id, _NEWEST: newest}, unless=done)
        finally:
            merged.unpersist()
    finally:
        batch.unpersist()


def upsert_stream(
    stream: DataFrame, root: str, checkpoint: str, key: str, event_time: str, delay: timedelta,
    available_now: bool = True,
) -> StreamingQuery:
    """Merge every micro-batch of ``stream`` into the table at ``root``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, root, key, event_time, delay)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watermark(spark: SparkSession, root: str, delay: timedelta) -> datetime | None:
    """The watermark that the next batch will meet, in UTC; none before the first event."""
    newest = read_manifest(spark, root).notes.get(_NEWEST)
    return None if newest is None else _EPOCH + timedelta(microseconds=newest) - delay
