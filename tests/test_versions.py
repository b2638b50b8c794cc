"""Versioned tables, the stream that merges into one, folder listings and report files."""

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.plans.crawl import crawl, frontier, store_crawl, stored_offers
from offerloom.sources import versions
from offerloom.sources.reports import write_reports
from offerloom.sources.snapshots import latest_folder, read_latest, write_snapshot
from offerloom.streaming.current import merge_batch, watermark


def ids(df):
    return sorted(r.id for r in df.collect())


def numbers(spark, low, high):
    return spark.range(low, high).coalesce(2)


def test_versions_replace_pin_and_drop(spark, tmp_path):
    root, schema = str(tmp_path / "t"), spark.range(0).schema
    assert ids(versions.read_entries(spark, root, schema)) == [] and versions.version_numbers(spark, root) == []
    assert versions.append_records(numbers(spark, 0, 3), root, "a") == 1
    assert versions.append_records(numbers(spark, 3, 5), root, "b") == 2
    pinned = versions.read_manifest(spark, root)
    assert versions.append_records(numbers(spark, 10, 12), root, "a") == 3
    assert ids(versions.read_entries(spark, root, schema)) == [3, 4, 10, 11]
    assert ids(versions.read_entries(spark, root, schema, version=pinned)) == [0, 1, 2, 3, 4]
    assert ids(versions.read_entries(spark, root, schema, "b")) == [3, 4]
    versions.commit(spark, root, {}, drop=["b"], notes={"x": 1})
    assert versions.read_manifest(spark, root).notes == {"x": 1}
    assert len(versions.clean_up(spark, root, keep=1)) == 2
    assert ids(versions.read_entries(spark, root, schema)) == [10, 11] and versions.version_numbers(spark, root) == [4]


def test_a_run_that_ends_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path / "t"), spark.range(0).schema
    versions.append_records(numbers(spark, 0, 3), root, "a")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(versions, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            versions.append_records(numbers(spark, 5, 9), root, "b")
    assert ids(versions.read_entries(spark, root, schema)) == [0, 1, 2]
    broken = numbers(spark, 0, 3).select((F.lit(1) / F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.append_records(broken, root, "c")
    versions.append_records(numbers(spark, 5, 9), root, "b")
    assert ids(versions.read_entries(spark, root, schema)) == [0, 1, 2, 5, 6, 7, 8]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """The second rename is refused, and both entries are there in the end."""
    root, schema = str(tmp_path / "t"), spark.range(0).schema
    real, other = versions._publish, []

    def interrupted(spark, root, version):
        if not other:
            other.append(1)
            versions.append_records(numbers(spark, 7, 9), root, "other")
        return real(spark, root, version)

    monkeypatch.setattr(versions, "_publish", interrupted)
    assert versions.append_records(numbers(spark, 0, 2), root, "mine") == 2
    assert ids(versions.read_entries(spark, root, schema)) == [0, 1, 7, 8]
    assert all(n.endswith(".json") or n.startswith(".") for n in os.listdir(f"{root}/_versions"))


def replay(batches, delay):
    """Current, expired and late rows as a plain loop gives them."""
    newest, current, expired, late = None, {}, [], []
    for batch in batches:
        for key, at in batch:
            if key is None or at is None or (newest is not None and at < newest - delay):
                late.append((key, at))
            else:
                current[key] = max(current.get(key, at), at)
        times = [at for _, at in batch if at is not None]
        newest = max([*times, *([newest] if newest else [])], default=None)
        if newest is not None:
            expired += [(k, at) for k, at in current.items() if at < newest - delay]
            current = {k: at for k, at in current.items() if at >= newest - delay}
    return current, expired, late


def test_merged_batches_against_a_plain_loop(spark, tmp_path):
    rng, start, delay = random.Random(2), datetime(2024, 1, 1), timedelta(hours=30)
    batches = [[(rng.choice("abcdefgh"), start + timedelta(hours=20 * b + rng.randint(-40, 20))) for _ in range(12)] for b in range(6)]
    batches[2] += [(None, start), ("z", None)]
    batches[4] = []
    root, schema = str(tmp_path / "t"), "k string, at timestamp_ntz"
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, schema)
        version = merge_batch(df, number, root, "k", "at", delay)
        # A batch that comes again is left alone.
        assert merge_batch(df, number, root, "k", "at", delay) == version == number + 1
    current, expired, late = replay(batches, delay)

    def held(prefix):
        rows = versions.read_entries(spark, root, spark.createDataFrame([], schema).schema, prefix).collect()
        return sorted(map(tuple, rows), key=repr)

    assert held("current") == sorted(current.items(), key=repr) and expired and late
    assert held("expired/") == sorted(expired, key=repr) and held("late/") == sorted(late, key=repr)
    assert watermark(spark, root, delay) == max(at for b in batches for _, at in b if at) - delay


def test_only_the_newest_snapshot_is_opened(spark, tmp_path):
    root, schema = str(tmp_path / "s"), spark.range(0).schema
    assert latest_folder(spark, root) is None and read_latest(spark, root, schema).count() == 0
    for day in (1, 3, 2):
        write_snapshot(spark.range(day), root, date(2024, 5, day))
    for odd in ("snapshot_date=2024-13-01", "snapshot_date=tmp_2025-01-01", "2025-01-01", "snapshot_date=2024-5-9"):
        os.makedirs(f"{root}/{odd}")
    found = read_latest(spark, root, schema)
    assert latest_folder(spark, root).endswith("snapshot_date=2024-05-03") and found.count() == 3
    assert all("snapshot_date=2024-05-03" in f for f in found.inputFiles())


def test_small_reports_are_one_file(spark, tmp_path):
    path = str(tmp_path / "reports")
    lines = spark.range(4_000).select(
        F.when(F.col("id") < 2_000, "large").otherwise(F.concat(F.lit("u"), F.col("id") % 5)).alias("user_id"),
        F.col("id").alias("place"), F.format_string("line %05d of a report", "id").alias("line"),
    )
    write_reports(spark.createDataFrame([("other", 0, "kept")], lines.schema), path, ["place"])
    for _ in range(2):
        write_reports(lines.repartition(7), path, ["place"], file_bytes=20_000)

    def files(user):
        return sorted(f for f in os.listdir(f"{path}/user_id={user}") if f.startswith("part-"))

    assert all(len(files(f"u{i}")) == 1 for i in range(5)) and len(files("large")) > 1 and len(files("other")) == 1
    for user, low in (("large", 0), ("u1", 2_001)):
        text = "".join(open(f"{path}/user_id={user}/{f}").read() for f in files(user)).splitlines()
        expected = [f"line {i:05d} of a report" for i in (range(2_000) if user == "large" else range(low, 4_000, 5))]
        assert text == expected


def test_crawled_offers_are_stored_once(spark, tmp_path):
    root = str(tmp_path / "crawled")
    pages = spark.createDataFrame([], schemas.PAGES)
    keywords = spark.createDataFrame([("analyst", "Peru")], schemas.KEYWORDS)
    found = crawl(pages, frontier(keywords, "https://jobs.example"), datetime(2024, 3, 1))
    for _ in range(2):
        store_crawl(found, root, date(2024, 3, 1))
    assert stored_offers(spark, root).count() == 0
    row = spark.range(3).select(*[F.lit("x").cast(f.dataType).alias(f.name) for f in schemas.RAW_OFFERS.fields])
    for _ in range(2):
        store_crawl(row, root, date(2024, 3, 2))
    assert stored_offers(spark, root).count() == 3
