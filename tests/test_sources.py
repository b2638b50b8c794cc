import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom import EngineConfig, schemas, shared_dir
from offerloom.functions.report import HEADER_LINES
from offerloom.operators.embedding import hashing_factory
from offerloom.operators.html import detail_rows, listing_links
from offerloom.plans import pipeline
from offerloom.plans.crawl import crawl, frontier
from offerloom.plans.report import (
    READING_ORDER,
    newest_then_best,
    numbered,
    report_lines,
    seeker_matches,
)
from offerloom.session import cut_lineage
from offerloom.sources.records import (
    CORRUPT,
    clean_skills,
    empty,
    read_inferred,
    read_records,
    read_skills,
    read_table,
    write_records,
)
from offerloom.sources.versions import append_records, read_entries
from offerloom.sources.reports import read_report, write_reports
from offerloom.sources.snapshots import (
    dated_folders,
    latest_day,
    list_files,
    read_latest,
    read_snapshots,
    snapshot_dates,
    write_snapshot,
)
from offerloom.streaming.ingest import append_log, current_rows, keyed, landing_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def dump(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_read_records(spark, tmp_path):
    schema = T.StructType.fromDDL("a string, b double")
    array = dump(tmp_path / "a.json", '[{"a": "x", "b": NaN}, {"a": "y", "c": 1}]')
    assert rows(read_records(spark, array, schema)) == [("x", None), ("y", None)] or rows(
        read_records(spark, array, schema)
    )[1] == ("y", None)
    missing = read_records(spark, str(tmp_path / "none.json"), schema)
    assert missing.count() == 0 and missing.schema == schema
    assert read_table(spark, str(tmp_path / "none"), schema).count() == 0
    lines = dump(tmp_path / "l.json", '{"a": "x", "b": 1.5}\n{"a": broken\n')
    assert rows(read_records(spark, lines, schema, lines=True)) == [("x", 1.5)]
    kept = read_records(spark, lines, schema, lines=True, keep_corrupt=True)
    assert [r[CORRUPT] for r in kept.collect()] == [None, '{"a": broken']
    assert dict(read_inferred(spark, array).dtypes)["c"] == "bigint"


def test_write_and_append_records(spark, tmp_path):
    df = spark.createDataFrame([("x", date(2024, 1, 1))], "link string, scraping_date date")
    for _ in range(2):
        append_records(df, str(tmp_path / "raw"), "2024-01-01")
    append_records(df, str(tmp_path / "raw"), "2024-01-02")
    assert read_entries(spark, str(tmp_path / "raw"), df.schema).count() == 2
    for _ in range(2):
        write_records(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_read_skills_in_both_shapes(spark, tmp_path):
    expected = [(0, "Python"), (1, "java"), (2, "python")]
    for i, shape in enumerate(
        ({"skills": ["Python", "java", "python"]},
         {"skills": {"0": "Python", "1": "java", "2": "python"}})
    ):
        skills = read_skills(spark, dump(tmp_path / f"{i}.json", shape))
        assert rows(skills) == expected
        assert rows(clean_skills(skills)) == [(0, "python"), (1, "java")]


def test_snapshots(spark, tmp_path):
    root, schema = str(tmp_path / "users"), T.StructType.fromDDL("user_id string, n bigint")
    assert read_latest(spark, root, schema).count() == 0
    table = spark.createDataFrame([("u1", 1)], schema)
    write_snapshot(table, root, date(2024, 1, 1))
    write_snapshot(table.withColumn("n", F.lit(5)), root, date(2024, 1, 5))
    os.makedirs(f"{root}/snapshot_date=not-a-date")
    table.write.parquet(f"{root}/snapshot_date=not-a-date", mode="overwrite")
    every = read_snapshots(spark, root, schema)
    assert every.count() == 3
    assert latest_day(every).first().latest == date(2024, 1, 5)
    assert rows(snapshot_dates(every)) == [(date(2024, 1, 1),), (date(2024, 1, 5),)]
    latest = read_latest(spark, root, schema)
    assert rows(latest) == [("u1", 5)] and latest.columns == ["user_id", "n"]
    assert all("snapshot_date=2024-01-05" in f for f in latest.inputFiles())
    # The day's own snapshot can be rebuilt from itself.
    write_snapshot(latest.withColumn("n", F.col("n") + 1), root, date(2024, 1, 5))
    assert rows(read_latest(spark, root, schema)) == [("u1", 6)]
    assert read_snapshots(spark, root, schema).count() == 3
    files = list_files(spark, root, ".parquet")
    assert rows(dated_folders(files)) == [
        ("snapshot_date=2024-01-01",), ("snapshot_date=2024-01-05",), ("snapshot_date=not-a-date",),
    ]


OFFERS = [("job1", "J 1", "l1", date(2024, 1, 15)), ("job2", "J [2]", "l2", date(2024, 2, 20)),
          ("job3", "J 3", "l3", date(2024, 2, 10)), ("job4", "J 4", "l4", date(2024, 2, 20))]
MATCHES = [("user1", "job1", 0.6), ("user1", "job2", 0.8), ("user2", "job2", 0.7),
           ("user2", "job3", 0.9), ("user2", "job4", 0.75), ("user2", "lost", 0.99)]


def matched(spark):
    offers = spark.createDataFrame(
        OFFERS, "job_id string, vacancy_name string, link string, publication_date date"
    )
    matches = spark.createDataFrame(MATCHES, "user_id string, job_id string, score double")
    return seeker_matches(matches, offers)


def test_matches_are_newest_then_best(spark):
    got = [(r.user_id, r.job_id) for r in newest_then_best(matched(spark)).collect()]
    expected = [("user1", "job2"), ("user1", "job1"), ("user2", "job4"), ("user2", "job2"),
                ("user2", "job3")]
    assert got == expected
    placed = numbered(matched(spark)).orderBy("user_id", "place").collect()
    assert [(r.user_id, r.job_id) for r in placed] == expected
    assert [r.place for r in placed] == [1, 2, 1, 2, 3]


def report_text(spark, path, user):
    lines = read_report(spark, path, user).collect()
    return [r.line for r in sorted(lines, key=lambda r: os.path.basename(r.file))]


def test_reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    users = spark.createDataFrame([("user1",), ("user2",), ("idle",)], "user_id string")
    write_reports(report_lines(matched(spark), users), path, READING_ORDER)
    assert report_text(spark, path, "idle") == list(HEADER_LINES)
    assert report_text(spark, path, "user1") == [
        *HEADER_LINES,
        "| [J 2](l2) | 80.00% | 2024-02-20 |",
        "| [J 1](l1) | 60.00% | 2024-01-15 |",
    ]
    assert [x[3:6] for x in report_text(spark, path, "user2")[3:]] == ["J 4", "J 2", "J 3"]
    none = report_lines(matched(spark), users.limit(0))
    assert none.count() == 0


def test_a_long_report_stays_in_order_over_many_files(spark, tmp_path):
    n, path = 5000, str(tmp_path / "long")
    body = spark.range(n).select(
        F.lit("u").alias("user_id"), F.col("id").cast("string").alias("job_id"),
        F.lit("t").alias("job_offer"), F.col("id").cast("string").alias("link"),
        (F.col("id") / n).alias("score"), F.lit("2024-01-01").cast("date").alias("publication_date"),
    )
    users = spark.createDataFrame([("u",)], "user_id string")
    write_reports(report_lines(body, users), path, READING_ORDER, file_bytes=20_000)
    lines = read_report(spark, path, "u").collect()
    assert len({r.file for r in lines}) > 1
    ordered = [r.line for r in sorted(lines, key=lambda r: os.path.basename(r.file))]
    links = [int(x.split("](")[1].split(")")[0]) for x in ordered[3:]]
    assert links == list(range(n - 1, -1, -1))


LISTING = """<html><b class="results-context-header__job-count"> 1,234 </b>
<ul class="jobs-search__results-list">
<li><a class="x base-card__full-link" href="HTTPS://co.example/jobs/view/a-1?trk=9#f">A</a>
<li><a class="base-card__full-link" href="https://co.example/jobs/view/a-1?trk=8">again</a></li>
<li><a class="base-card__full-link" href="https://co.example/company/z">no job</a></li>
<li><a class="base-card__full-link">no href</a></li>
<li><a href="https://co.example/jobs/view/plain">no class</a></li></ul>
<a class="base-card__full-link" href="https://co.example/jobs/view/outside">outside</a></html>"""
FALLBACK = '<div><a class="base-card__full-link" href="/jobs/view/b-2;v=1">B</a></div>'
DETAIL = """<div><h1 class="top-card-layout__title topcard__title">
 Data &amp; AI <em>Engineer</em></h1>
<a class="topcard__org-name-link"> Acme </a>
<h4 class="top-card-layout__second-subline"><span class="topcard__flavor">Acme</span>
<span class="topcard__flavor topcard__flavor--bullet"> Bogotá </span>
<span class="posted-time-ago__text"> Hace 3 días </span></h4>
<div class="show-more-less-html__markup"><p>Do <b>things</b><br>well<script>no()</script></p></div>
<ul><li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">
 Nivel de antigüedad </h3><span class="description__job-criteria-text"> Senior </span></li>
<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Employment type</h3>
<span class="description__job-criteria-text">Full-time</span></li>
<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Función laboral</h3>
<span class="description__job-criteria-text">IT</span></li>
<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Industries</h3>
<span class="description__job-criteria-text">Software</span></li>
<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Broken</h3></li>
</ul></div>"""
TITLE = '<h1 class="top-card-layout__title">T</h1>'


def pages_of(spark, bodies):
    return spark.createDataFrame(list(bodies.items()), "url string, body string")


def test_listing_links(spark):
    pages = pages_of(spark, {"s1": LISTING, "s2": FALLBACK, "s3": LISTING + "authwall", "s4": None,
                             "https://www.linkedin.com/authwall?x": LISTING})
    assert rows(listing_links(pages)) == [
        ("s1", 1234, "https://co.example/jobs/view/a-1"), ("s2", 0, "/jobs/view/b-2"),
    ]


def flavors(*texts):
    spans = "".join(f'<span class="topcard__flavor">{t}</span>' for t in texts)
    return f'{TITLE}<h4 class="top-card-layout__second-subline">{spans}</h4>'


def test_detail_rows(spark):
    insight = '<div class="job-details-jobs-unified-top-card__job-insight">{}</div>'
    pages = pages_of(spark, {
        "full": DETAIL, "untitled": "<h1>x</h1>", "blocked": DETAIL + "authwall", "bare": TITLE,
        "two": flavors("Acme", "Cali"), "applicants": flavors("Acme", "25 Solicitudes"),
        "aged": flavors("Acme", "hace 2 horas"), "one": flavors("Acme"), "zero": flavors(),
        "insight": TITLE + insight.format(" Senior · Full-time · x"),
        "no_dot": TITLE + insight.format("Senior"),
    })
    got = {r.url: r for r in detail_rows(pages, "2024-03-10 09:00:00").collect()}
    assert "untitled" not in got and "blocked" not in got and len(got) == 9
    full = got["full"]
    assert full.vacancy_name == "Data & AI Engineer" and full.company == "Acme"
    assert full.location == "Bogotá" and full.publication_date == date(2024, 3, 7)
    assert full.description == "Do thingswell"
    assert (full.seniority, full.work_modality_english, full.job_function, full.industries) == (
        "Senior", "Full-time", "IT", "Software",
    )
    bare = got["bare"]
    assert bare.publication_date == date(2024, 3, 10)
    assert (bare.company, bare.location, bare.description, bare.seniority) == (None,) * 4
    places = {k: got[k].location for k in ("two", "applicants", "aged", "one", "zero")}
    assert places == {"two": "Cali", "applicants": "Acme", "aged": "Acme", "one": "Acme", "zero": None}
    assert (got["insight"].seniority, got["insight"].work_modality_english) == ("Senior", "Full-time")
    assert got["no_dot"].seniority is None


def test_crawl(spark):
    keywords = spark.createDataFrame([("Data Engineer", "Colombia"), ("", "x")], schemas.KEYWORDS)
    searches = frontier(keywords, "https://co.example/search")
    url = searches.first().url
    assert "keywords=Data%2BEngineer&" in url and searches.count() == 1
    at, early = datetime(2024, 3, 9), datetime(2024, 3, 8)
    job = "https://co.example/jobs/view/a-1"
    pages = spark.createDataFrame(
        [(url, 200, LISTING, at), (f"{job}?ref=1", 200, DETAIL, at),
         (job, 200, DETAIL.replace("Acme", "Old"), early), (job, 500, DETAIL.replace("Acme", "Err"), at),
         ("https://co.example/jobs/view/unlisted", 200, DETAIL, at)],
        schemas.PAGES,
    )
    found = crawl(pages, searches, datetime(2024, 3, 10))
    assert found.columns == schemas.RAW_OFFERS.fieldNames()
    row = found.collect()
    assert len(row) == 1 and row[0].link == job and row[0].company == "Acme"
    assert (row[0].query_keyword, row[0].country) == ("Data Engineer", "Colombia")
    assert (row[0].publication_date, row[0].scraping_date) == ("2024-03-07", "2024-03-10")
    assert crawl(pages, searches, datetime(2024, 3, 10), max_jobs=0).count() == 0


def test_streaming_ingest(spark, tmp_path):
    landing, log = tmp_path / "landing", str(tmp_path / "log")
    landing.mkdir()
    good = {"link": "https://x.example/1", "description": "remote", "vacancy_name": "v"}

    def run(name, records):
        dump(landing / name, "\n".join(json.dumps(r) for r in records))
        stream = keyed(landing_stream(spark, str(landing), 1))
        append_log(stream, log, str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(log)

    first = run("1.json", [good, {"link": None, "description": "x"}])
    assert first.count() == 1 and first.first().remote is True
    second = run("2.json", [{**good, "description": "on site"}, {**good, "link": "https://x.example/2"}])
    assert second.count() == 3
    now = {r.link: r.description for r in current_rows(second).collect()}
    assert now == {"https://x.example/1": "on site", "https://x.example/2": "remote"}


def test_pipeline_runs_twice(spark, tmp_path):
    names = [f.name for f in schemas.SEEKERS.fields]
    seeker = dict.fromkeys(names) | {
        "user_id": "u1", "seniority": ["Senior"], "location": ["Bogota"],
        "work_modality_english": ["Full-time"], "remote": ["True", "False"], "english": "True",
        "role_weight": "0.5", "similarity_threshold": "-1", "skills": ["python"],
        "job_titles": ["Data Engineer"],
    }

    def offer(i, **more):
        return {"link": f"https://x.example/{i}?t=1", "description": f"python job {i}",
                "vacancy_name": "Data Engineer", "company": "A", "seniority": "Senior",
                "location": "Bogota", "work_modality_english": "Full-time",
                "publication_date": "2024-03-09", **more}

    pages = [("https://x.example/2", 404, None, None)]
    spark.createDataFrame(pages, schemas.PAGES).write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("the",)], schemas.WORDS).write.parquet(str(tmp_path / "words"))
    config = EngineConfig(
        raw_offers=dump(tmp_path / "raw.json", [offer(1), offer(2), offer(3, company="Fake")]),
        seekers=dump(tmp_path / "seekers.json", [seeker]),
        skills=dump(tmp_path / "skills.json", {"skills": ["python", "sql"]}),
        pages=str(tmp_path / "pages"), word_list=str(tmp_path / "words"),
        offers=str(tmp_path / "offers"), embeddings=str(tmp_path / "embeds"),
        matches=str(tmp_path / "matches"), reports=str(tmp_path / "reports"),
        excluded_companies=("Fake",), unavailable_tags=("closed",), report_users=("u1", "u2"),
    )
    for _ in range(2):
        pipeline.run(spark, config, datetime(2024, 3, 10, 9), hashing_factory(16))
        kept = read_latest(spark, config.offers, schemas.OFFERS)
        assert [r.link for r in kept.collect()] == ["https://x.example/1"]
        found = read_latest(spark, config.matches, schemas.MATCHES).collect()
        assert [(r.user_id, r.score) for r in found] == [("u1", 1.0)]
        assert report_text(spark, config.reports, "u1")[3] == (
            "| [Data Engineer](https://x.example/1) | 100.00% | 2024-03-09 |"
        )
        assert report_text(spark, config.reports, "u2") == list(HEADER_LINES)
    dump(tmp_path / "raw.json", [offer(4)])
    pipeline.run(spark, config, datetime(2024, 3, 11, 9), hashing_factory(16))
    kept = read_latest(spark, config.offers, schemas.OFFERS)
    assert sorted(r.link[-1] for r in kept.collect()) == ["1", "4"]


def test_config():
    config = EngineConfig.from_mapping(
        {"offers": "/data/offers", "excluded_companies": "['A', 'B']", "recency_days": "3",
         "english_threshold": "0.5", "embed_limit": "5000"}
    )
    assert config.excluded_companies == ("A", "B") and config.recency_days == 3
    assert config.english_threshold == 0.5 and config.embed_limit == 5000
    with pytest.raises(ValueError, match="unknown settings"):
        EngineConfig.from_mapping({"colour": "x"})


def test_shared_dir_and_lineage(spark):
    folder = shared_dir(spark)
    assert folder == shared_dir(spark)
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().toString()
    assert empty(spark, schemas.SKILLS).columns == ["pos", "skill"]


def test_pipeline_sets_unreadable_and_unusable_rows_aside(spark, tmp_path):
    good = {"link": "https://x.io/1", "description": "python", "publication_date": "2024-03-09", "scraping_date": "2024-03-10"}
    lines = [json.dumps(good), "{broken", json.dumps({**good, "link": None}), json.dumps({**good, "link": "https://x.io/2", "publication_date": "soon"})]
    (tmp_path / "raw.json").write_text("\n".join(lines))
    (tmp_path / "seekers.json").write_text('{"user_id": "u1"}\n{"user_id":')
    (tmp_path / "skills.json").write_text('{"skills": ["python"]}')
    config = EngineConfig(
        **{name: str(tmp_path / name) for name in ("offers", "pages", "word_list", "embeddings", "matches", "reports", "quarantine")},
        **{name: str(tmp_path / f"{file}.json") for name, file in (("raw_offers", "raw"), ("seekers", "seekers"), ("skills", "skills"))},
    )
    counts = pipeline.run(spark, config, datetime(2024, 3, 10, 9), hashing_factory(16), lines=True)
    assert counts == {
        "raw_offers: record unreadable": 1, "raw_offers: link missing": 1,
        "raw_offers: publication_date unreadable": 1, "seekers: record unreadable": 1,
    }
    rows = spark.read.parquet(config.quarantine).where("snapshot_date = '2024-03-10'").collect()
    assert len(rows) == 4 and {"{broken", '{"user_id":'} <= {r.record for r in rows}
    (tmp_path / "raw.json").write_text(lines[0])
    (tmp_path / "seekers.json").write_text('{"user_id": "u1"}')
    assert pipeline.run(spark, config, datetime(2024, 3, 10, 9), hashing_factory(16), lines=True) == {}
    assert spark.read.schema("record string").parquet(config.quarantine).count() == 0
