"""Snapshots and the streaming ingest."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.bindings import Bound, table
from offerloom.session import shared_dir
from offerloom.sources.snapshots import latest_rows, snapshot_dates
from offerloom.sources.versions import append_records, read_entries
from offerloom.streaming.current import upsert_stream
from offerloom.streaming.ingest import append_log, current_rows, first_in_window


def _named_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events under the name of their day's snapshot; one type has unreadable names."""
    day = F.date_format("ts", "yyyy-MM-dd")
    name = F.when(F.col("event_type") == "signup", F.concat(F.lit("tmp_"), day)).otherwise(day)
    return table(spark, folder, "events").select(
        "event_id", "event_type", name.alias("snapshot_date")
    )


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return latest_rows(_named_events(spark, folder))


LATEST_SNAPSHOT_SQL = """
SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS snapshot_date FROM events
WHERE event_type <> 'signup'
  AND ts::DATE = (SELECT max(ts::DATE) FROM events WHERE event_type <> 'signup')
"""


def snapshot_days(spark: SparkSession, folder: str) -> DataFrame:
    days = snapshot_dates(_named_events(spark, folder))
    return days.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"))


SNAPSHOT_DAYS_SQL = """
SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS snapshot_date FROM events WHERE event_type <> 'signup'
"""


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    # A glob is taken for a file as well as for a folder of files.
    return spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")


def _run_to_log(spark: SparkSession, stream: DataFrame) -> DataFrame:
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    append_log(stream, f"{root}/log", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/log")


def stream_new_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Each user once, deduplicated in the stream."""
    stream = first_in_window(_event_stream(spark, folder), "user_id", "ts", "60 days")
    return _run_to_log(spark, stream.select("user_id")).select("user_id")


STREAM_NEW_KEYS_SQL = "SELECT DISTINCT user_id FROM events"


def stream_current_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended by the stream, then one row per event id when read."""
    log = _run_to_log(spark, _event_stream(spark, folder).drop("ts"))
    return current_rows(log, "event_id")


STREAM_CURRENT_ROWS_SQL = "SELECT event_id, user_id, event_type, value, props FROM events"

def appended_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended by kind, every batch twice, as the newest version reads them."""
    events = table(spark, folder, "events")
    root = f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]
    for _ in range(2):
        for kind in kinds:
            append_records(events.where(F.col("event_type").eqNullSafe(F.lit(kind))), root, f"kind-{kind}")
    return read_entries(spark, root, events.schema).drop("ts")


#: Spans in which events arrive, by how many spans sign-ups come late, and the delay.
SPANS, LATE_BY, DELAY = 5, 2, timedelta(days=7)


def stream_live_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose newest event is not older than the watermark, and the events that came late.

    Events land span by span and the stream is started again for each, so that rows expire
    between micro-batches. Times count from the first event.
    """
    events = table(spark, folder, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    span = F.least(F.lit(SPANS - 1), F.floor((at - low) * SPANS / F.lit(max(high - low, 1))))
    arrival = span + F.when(F.col("event_type") == "signup", LATE_BY).otherwise(0)
    root = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    landing = spark.readStream.schema(events.schema).option("recursiveFileLookup", True)
    for number in range(SPANS + LATE_BY):
        events.where(arrival == number).write.parquet(f"{root}/landing/{number}")
        stream = landing.parquet(f"{root}/landing")
        upsert_stream(stream, f"{root}/live", f"{root}/state", "user_id", "ts", DELAY).awaitTermination()
    live = read_entries(spark, f"{root}/live", events.schema, "current")
    late = read_entries(spark, f"{root}/live", events.schema, "late/")
    none = F.lit(None).cast("bigint")
    return live.select(F.lit("current").alias("kind"), "user_id", none.alias("event_id"), (at - low).alias("micros")).unionByName(
        late.select(F.lit("late").alias("kind"), "user_id", "event_id", (at - low).alias("micros"))
    )


STREAM_LIVE_ROWS_SQL = f"""
WITH span AS (SELECT min(epoch_us(ts)) AS low, greatest(max(epoch_us(ts)) - min(epoch_us(ts)), 1) AS width FROM events),
e AS (
  SELECT event_id, user_id, epoch_us(ts) - low AS micros,
         least({SPANS - 1}, ((epoch_us(ts) - low) * {SPANS}) // width)
         + CASE WHEN event_type = 'signup' THEN {LATE_BY} ELSE 0 END AS arrival
  FROM events, span
), tops AS (SELECT arrival, max(micros) AS top FROM e GROUP BY arrival),
marks AS (
  SELECT arrival, max(top) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  - {DELAY // timedelta(microseconds=1)} AS mark
  FROM tops
), judged AS (SELECT e.*, coalesce(micros < mark, false) OR user_id IS NULL AS late FROM e JOIN marks USING (arrival))
SELECT 'late' AS kind, user_id, event_id, micros FROM judged WHERE late
UNION ALL
SELECT 'current', user_id, NULL, max(micros) FROM judged WHERE NOT late GROUP BY user_id
HAVING max(micros) >= (SELECT max(micros) FROM e) - {DELAY // timedelta(microseconds=1)}
"""

QUERIES = {
    "appended_batches": Bound(appended_batches, STREAM_CURRENT_ROWS_SQL),
    "stream_live_rows": Bound(stream_live_rows, STREAM_LIVE_ROWS_SQL),
    "latest_snapshot": Bound(latest_snapshot, LATEST_SNAPSHOT_SQL),
    "snapshot_days": Bound(snapshot_days, SNAPSHOT_DAYS_SQL),
    "stream_new_keys": Bound(stream_new_keys, STREAM_NEW_KEYS_SQL),
    "stream_current_rows": Bound(stream_current_rows, STREAM_CURRENT_ROWS_SQL),
}
