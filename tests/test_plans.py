from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.operators.availability import (
    check_offers,
    expire_by_pages,
    keep_available,
    still_available,
    with_check_results,
)
from offerloom.operators.embedding import HashingModel, embed_phrases, hashing_factory
from offerloom.operators.rules import criteria, match_rules, matched_totals, parse_seekers
from offerloom.operators import scoring
from offerloom.operators.scoring import score_matches
from offerloom.plans.embed import embed_offers, embed_seekers
from offerloom.plans.match import recommend, rule_matches, with_language
from offerloom.plans.offers import (
    augment,
    build_offers,
    newest_first,
    split_unusable,
    title_extract,
    transform,
)
from offerloom.sources.records import empty

AS_OF = datetime(2024, 3, 10, 9)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def raw_table(spark, records):
    names = [f.name for f in schemas.RAW_OFFERS.fields]
    return spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in records], schemas.RAW_OFFERS
    )


def offer_table(spark, records):
    names = [f.name for f in schemas.OFFERS.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schemas.OFFERS)


def skill_table(spark):
    return spark.createDataFrame(
        list(enumerate(["welding", "drafting", "crane driving", "remote"])), "pos bigint, skill string"
    )


TWO = [
    {"link": "https://shop.test/offers/job1?trk=1", "description": "We use Welding and crane driving",
     "vacancy_name": "Welder", "company": "Harbour Mills", "publication_date": "2024-03-08"},
    {"link": "https://shop.test/offers/job2", "description": "A remote role with Drafting",
     "vacancy_name": "Draughtsman", "company": "Lantern Works", "publication_date": "2024-03-09"},
]


def test_two_offers(spark):
    raw, none = raw_table(spark, TWO), empty(spark, schemas.OFFERS)
    built = newest_first(build_offers(raw, none, skill_table(spark), AS_OF)).collect()
    assert [r.link for r in built] == ["https://shop.test/offers/job2", "https://shop.test/offers/job1"]
    assert [r.remote for r in built] == [True, False]
    assert [r.skills for r in built] == [["drafting", "remote"], ["welding", "crane driving"]]
    assert len({r.job_id for r in built}) == 2 and all(len(r.job_id) == 22 for r in built)


def test_stale_blank_offer_gives_nothing(spark):
    blank = {n: "" for n in ("link", "description", "vacancy_name", "company")}
    raw = raw_table(spark, [{**blank, "publication_date": "2024-02-09"}])
    built = build_offers(raw, empty(spark, schemas.OFFERS), skill_table(spark), AS_OF)
    assert built.count() == 0 and built.columns == schemas.OFFERS.fieldNames()


MIXED = TWO + [
    {"link": "https://shop.test/offers/job1?trk=2", "description": "Second copy of the link",
     "publication_date": "2024-03-07", "company": "Harbour Mills"},
    {"link": "https://shop.test/offers/job3", "description": "A remote role with Drafting",
     "publication_date": "2024-03-05", "company": None},
    {"link": "https://shop.test/offers/job4", "description": "too old", "publication_date": "2024-03-03"},
    {"link": "https://shop.test/offers/job5", "description": "spam", "publication_date": "2024-03-09",
     "company": "Fake"},
    {"link": None, "description": "no link", "publication_date": "2024-03-09"},
    {"link": "https://shop.test/offers/job6", "description": None, "publication_date": "2024-03-09"},
    {"link": "https://shop.test/offers/job7", "description": "bad date", "publication_date": "soon"},
    {"link": "https://shop.test/offers/job8", "description": "now spam", "publication_date": "2024-03-09",
     "company": "Fake", "scraping_date": "2024-03-10"},
]


def stored(spark):
    base = {"remote": False, "skills": ["sql"], "available": True,
            "publication_date": date(2024, 3, 9)}
    with_id = build_offers(
        raw_table(spark, [{"link": "https://shop.test/offers/job8", "description": "x",
                           "publication_date": "2024-03-09"}]),
        empty(spark, schemas.OFFERS), skill_table(spark), AS_OF,
    ).first().job_id
    return offer_table(spark, [
        {**base, "job_id": with_id, "link": "https://shop.test/offers/job8", "description": "stored 8"},
        {**base, "job_id": "s9", "link": "https://shop.test/offers/job9", "description": "stored 9"},
        {**base, "job_id": "s10", "link": "https://shop.test/offers/job10", "description": "untagged",
         "skills": None},
        {**base, "job_id": "s11", "link": "https://shop.test/offers/job11", "description": "stored 9",
         "publication_date": date(2024, 3, 8)},
    ])


def test_masked_plan_equals_the_two_steps(spark):
    raw, old, skills = raw_table(spark, MIXED), stored(spark), skill_table(spark)
    fused = build_offers(raw, old, skills, AS_OF, ["Fake"])
    steps = transform(augment(raw, old, skills), AS_OF, ["Fake"])
    assert rows(fused) == rows(steps)
    links = sorted(r.link.rsplit("/", 1)[1] for r in fused.collect())
    # job3 shares job2's text, job4 is old, job8's new row is excluded and hides the stored one.
    assert links == ["job1", "job2", "job9"]


def test_clean_offers_stay_clean(spark):
    raw, old, skills = raw_table(spark, MIXED), stored(spark), skill_table(spark)
    once = build_offers(raw, old, skills, AS_OF, ["Fake"])
    again = build_offers(empty(spark, schemas.RAW_OFFERS), once, skills, AS_OF, ["Fake"])
    assert rows(once) == rows(again)


def test_bad_rows_are_set_aside_with_a_reason(spark):
    good, bad = split_unusable(raw_table(spark, MIXED))
    assert good.count() == 7
    assert sorted(r.reason for r in bad.collect()) == [
        "description missing", "link missing", "publication_date unreadable",
    ]


def test_canonical_keys_join_postings_with_other_queries(spark):
    none, skills = empty(spark, schemas.OFFERS), skill_table(spark)
    raw = raw_table(spark, [MIXED[0], MIXED[2]])
    assert augment(raw, none, skills).count() == 2
    assert augment(raw, none, skills, key_on="canonical").count() == 1


def test_title_extract(spark):
    offers = offer_table(spark, [
        {"job_id": str(i), "industries": ind, "vacancy_name": f"t{i}", "description": f"d{i}",
         "publication_date": date(2024, 3, i + 1)}
        for i, ind in enumerate(["IT", "Banking", "IT", "IT"])
    ])
    assert [r.vacancy_name for r in title_extract(offers, ["IT"], 2).collect()] == ["t3", "t2"]
    assert title_extract(offers, ["IT"], None).count() == 3


def test_availability_rule(spark):
    cases = [
        ("1", "l", 200, "fine", True), ("1", "l", 404, "fine", False),
        ("1", "l", 200, "ya no está disponible", False), (None, "l", 200, "fine", False),
        ("1", None, 200, "fine", False), ("", "l", 200, "fine", False),
        ("1", "l", 429, "slow down", True), ("1", "l", None, None, True),
    ]
    df = spark.createDataFrame(cases, "j string, l string, s int, b string, e boolean")
    got = df.select(
        still_available(*[F.col(c) for c in "jlsb"], ["no está disponible", "closed"]), "e"
    ).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def availability_offers(spark):
    return offer_table(spark, [
        {"job_id": "1", "link": "l1", "available": True},
        {"job_id": "2", "link": "l2", "available": True},
        {"job_id": "3", "link": "l3", "available": None},
        {"job_id": "4", "link": "l4", "available": False},
        {"job_id": "5", "link": None, "available": True},
        {"job_id": "6", "link": "l6", "available": None},
    ])


def test_update_keeps_checked_and_available(spark):
    checks = spark.createDataFrame(
        [("1", True), ("2", False), ("3", True), ("4", True)], schemas.CHECKS
    )
    offers = availability_offers(spark)
    states = {r.job_id: r.available for r in with_check_results(offers, checks).collect()}
    assert states == {"1": True, "2": False, "3": True, "4": False, "5": None, "6": None}
    assert sorted(r.job_id for r in keep_available(offers, checks).collect()) == ["1", "3"]


def test_expiry_in_one_step_equals_check_and_update(spark):
    at = datetime(2024, 3, 9)
    pages = spark.createDataFrame(
        [
            ("l1", 200, "fine", at), ("l2", 404, None, at), ("l2", 200, "fine", datetime(2024, 3, 1)),
            ("l3?x=1", 200, "this job is closed", at), ("l4", 200, "fine", at),
        ],
        schemas.PAGES,
    )
    offers = availability_offers(spark)
    checked = keep_available(offers, check_offers(offers, pages, ["closed"]))
    expired = expire_by_pages(offers, pages, ["closed"])
    assert sorted(r.job_id for r in expired.collect()) == ["1", "6"]
    assert rows(checked.select(*offers.columns)) == rows(expired)


SEEKER = {"user_id": "user1", "seniority": ["Senior", "Senior"], "location": ["Tarma"],
          "work_modality_english": ["Full-time"], "remote": ["True"], "english": "True",
          "role_weight": "0.7", "similarity_threshold": "0.5", "skills": [], "job_titles": []}
OFFERS = [
    {"job_id": "job1", "seniority": "Senior", "location": "Tarma", "company": "Harbour Mills",
     "work_modality_english": "Full-time", "remote": True, "description": "the english text"},
    {"job_id": "job2", "seniority": "Junior", "location": "Jauja", "company": "Quarry Lane",
     "work_modality_english": "Part-time", "remote": False, "description": "the english text"},
    {"job_id": "job3", "seniority": "Senior", "location": "Tarma", "company": None,
     "work_modality_english": "Full-time", "remote": True, "description": "un texto español"},
    {"job_id": "job4", "seniority": "Senior", "location": "Tarma", "company": "Fake",
     "work_modality_english": "Full-time", "remote": True, "description": "un texto español"},
]


def seeker_table(spark, *changes):
    names = [f.name for f in schemas.SEEKERS.fields]
    return spark.createDataFrame(
        [tuple({**SEEKER, **c}.get(n) for n in names) for c in changes], schemas.SEEKERS
    )


def word_table(spark):
    return spark.createDataFrame([("the",), ("english",), ("text",)], schemas.WORDS)


def test_rule_filter(spark):
    seekers = seeker_table(
        spark, {}, {"user_id": "spanish_user", "english": "False"},
        {"user_id": "odd", "english": "maybe"}, {"user_id": "nowhere", "location": ["Paris"]},
        {"user_id": "blank", "location": None},
    )
    offers, words = offer_table(spark, OFFERS), word_table(spark)
    got = rows(rule_matches(offers, seekers, words, ["Fake"]))
    assert got == [("spanish_user", "job3"), ("user1", "job1"), ("user1", "job3")]
    one = rule_matches(offers, seekers, words, ["Fake"], user_id="spanish_user")
    assert rows(one) == [("spanish_user", "job3")]
    assert rule_matches(offers, seekers, words, user_id="unknown").count() == 0


def test_rule_join_has_no_nested_loop(spark, monkeypatch):
    offers = with_language(offer_table(spark, OFFERS), word_table(spark))
    profiles = parse_seekers(seeker_table(spark, {}, {"user_id": "u2"}))
    small = match_rules(offers, profiles)
    monkeypatch.setattr("offerloom.operators.rules.BROADCAST_ROWS", 0)
    large = match_rules(offers, profiles)
    assert rows(small) == rows(large)
    for df in (small, large):
        assert "NestedLoop" not in df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("cell_rows", [2, 1_000_000])
def test_matched_totals_equal_grouped_pairs(spark, cell_rows):
    """Hot combinations, repeated and null offers and excluded companies; no pair is made."""
    offers = spark.createDataFrame(
        [(None if i % 11 == 0 else str(i // 2), "usual" if i % 5 else None, "1995" if i % 7 else "1996", "any", True,
          "bad" if i % 13 == 0 else None, [True, False, None][i % 3]) for i in range(400)],
        "job_id string, seniority string, location string, work_modality_english string, remote boolean, company string, is_english boolean",
    )
    profiles = spark.createDataFrame(
        [(f"u{i}", ["usual", "usual"] if i % 4 else [None, "usual"], ["1995", "1996"] if i % 3 else ["1997"], ["any"], [True, False], i % 2 == 0)
         for i in range(60)],
        "user_id string, seniority array<string>, location array<string>, work_modality_english array<string>, remote array<boolean>, english boolean",
    )
    job = F.col("job_id").cast("long")
    pairs = match_rules(offers, profiles, ["bad"])
    expected = pairs.groupBy("user_id").agg(F.count("*"), F.min(job), F.sum(job))
    got = matched_totals(offers, profiles, job, ["bad"], cell_rows)
    assert rows(got) == rows(expected) and got.count() == 40


def test_skewed_rule_query_makes_no_pairs(spark, tmp_path):
    """3,000 offers and 600 seekers share one combination: 1.8 million pairs, but 600 joined rows."""
    from offerloom.bindings.matching import rule_filter_skewed

    spark.range(3_000).select(
        F.col("id").alias("o_orderkey"), F.lit("2-HIGH").alias("o_orderpriority"),
        F.lit("1995-03-01").cast("timestamp").alias("o_orderdate"), F.lit("O").alias("o_orderstatus"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(600).select((F.col("id") * 20).alias("s_suppkey"), F.lit(7).alias("s_nationkey")).write.parquet(
        f"{tmp_path}/supplier.parquet"
    )
    found = rule_filter_skewed(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Offers are summed up below the join: their key is not among what is joined.
    assert "o_orderkey" not in plan.split("Join Inner")[0]
    assert {tuple(r)[1:] for r in found.collect()} == {(3_000, 0, 2_999 * 1_500)} and found.count() == 600


def test_a_repeated_seeker_counts_once(spark):
    profiles = parse_seekers(seeker_table(spark, {}, {"role_weight": "0.1"}))
    assert profiles.count() == 1
    assert criteria(profiles).count() == 2


def embeds(spark):
    seekers = spark.createDataFrame(
        [("user1", [0.1, 0.2, 0.3], [0.4, 0.5, 0.6]), ("spanish_user", [0.3, 0.1, 0.0], [1.0, 0.0, 0.2]),
         ("zero", [0.0, 0.0, 0.0], [1.0, 1.0, 1.0])],
        "user_id string, avg_skill_embeds array<double>, avg_role_embeds array<double>",
    )
    offers = spark.createDataFrame(
        [("job1", [0.1, 0.2, 0.3], [0.4, 0.5, 0.6]), ("job2", [0.2, 0.3, 0.4], [0.5, 0.6, 0.7]),
         ("job3", [0.9, -0.2, 0.3], [0.1, 0.5, -0.6]), ("job4", [1.0, 1.0, 1.0], [1.0, 0.0, 0.0])],
        "job_id string, avg_skill_embeds array<double>, role_embeds array<double>",
    )
    return offers, seekers


def test_equal_vectors_score_one(spark):
    offer_embeds, seeker_embeds = embeds(spark)
    found = recommend(
        offer_table(spark, OFFERS), seeker_table(spark, {}), word_table(spark),
        offer_embeds, seeker_embeds, AS_OF, ["Fake"],
    )
    assert found.columns == schemas.MATCHES.fieldNames()
    assert rows(found) == [("user1", "job1", "user1|job1", date(2024, 3, 10), 1.0)]


def test_all_score_routes_agree_with_brute_force(spark, monkeypatch):
    offer_embeds, seeker_embeds = embeds(spark)
    seekers = seeker_table(
        spark,
        {"similarity_threshold": "-1"},
        {"user_id": "spanish_user", "english": "False", "similarity_threshold": "0.2"},
        {"user_id": "zero", "similarity_threshold": "-1"},
        {"user_id": "no_vectors"},
    )
    profiles = parse_seekers(seekers)
    offers = with_language(offer_table(spark, OFFERS), word_table(spark))
    tables = (offers, offer_embeds, profiles, seeker_embeds, ["Fake"])
    by_broadcast = score_matches(*tables)
    by_shuffle = score_matches(*tables, broadcast_bytes=0)
    by_salts = score_matches(*tables, broadcast_bytes=0, offers_per_salt=1)
    monkeypatch.setattr(scoring, "BLOCK", 1)
    by_rows = score_matches(*tables)

    def cosine(a, b):
        return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 4)

    vectors = {r.job_id: r for r in offer_embeds.collect()}
    people = {r.user_id: r for r in seeker_embeds.collect()}
    expected = {}
    for user, job, floor in (("user1", "job1", -1), ("user1", "job3", -1),
                             ("spanish_user", "job3", 0.2)):
        o, s = vectors[job], people[user]
        score = 0.7 * cosine(o.role_embeds, s.avg_role_embeds) + (1 - 0.7) * cosine(
            o.avg_skill_embeds, s.avg_skill_embeds
        )
        if score >= floor:
            expected[user, job] = pytest.approx(score, abs=1e-12)
    for df in (by_broadcast, by_shuffle, by_salts, by_rows):
        assert {(r.user_id, r.job_id): r.score for r in df.collect()} == expected


def test_unequal_vectors_stop_the_run(spark):
    offer_embeds, seeker_embeds = embeds(spark)
    short = offer_embeds.withColumn("role_embeds", F.slice("role_embeds", 1, 2))
    offers = with_language(offer_table(spark, OFFERS), word_table(spark))
    profiles = parse_seekers(seeker_table(spark, {}))
    with pytest.raises(Exception, match="equal length"):
        score_matches(offers, short, profiles, seeker_embeds).collect()


def vector(*phrases):
    return np.mean(HashingModel(16)(phrases).astype(np.float32), axis=0)


def test_hashing_model_is_unit_length_and_stable():
    vectors = HashingModel(768)(["Data Engineer", "Data Engineer", "Chef"])
    assert vectors.shape == (3, 768)
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1, atol=1e-6)
    assert np.array_equal(vectors[0], vectors[1]) and not np.array_equal(vectors[0], vectors[2])


def test_each_phrase_is_embedded_once(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "phrase string")
    got = embed_phrases(df, hashing_factory(16), partitions=2).collect()
    assert sorted(r.phrase for r in got) == ["a", "b"]


def embed_inputs(spark):
    offers = spark.createDataFrame(
        [("j1", ["welding", "sql", "sql"], "Data Engineer", date(2024, 3, 1)),
         ("j2", ["drafting"], "Backend", date(2024, 3, 2)),
         ("j3", [], "No skills", date(2024, 3, 3)), ("j4", ["welding"], None, date(2024, 3, 4))],
        "job_id string, skills array<string>, vacancy_name string, publication_date date",
    )
    return offers, empty(spark, schemas.OFFER_EMBEDS)


def test_cold_start_and_incremental_offers(spark):
    offers, none = embed_inputs(spark)
    full = embed_offers(offers, none, hashing_factory(16))
    got = {r.job_id: r for r in full.collect()}
    assert set(got) == {"j1", "j2"}
    assert got["j1"].avg_skill_embeds == pytest.approx(vector("welding", "sql", "sql"), abs=1e-6)
    assert got["j1"].role_embeds == pytest.approx(vector("Data Engineer"), abs=1e-6)
    first = embed_offers(offers.where("job_id = 'j1'"), none, hashing_factory(16))
    second = embed_offers(offers, first, hashing_factory(16))
    assert rows(second) == rows(full)
    # Offers that are gone keep their embedding.
    assert rows(embed_offers(offers.limit(0), full, hashing_factory(16))) == rows(full)


def test_embedding_limit_takes_the_newest(spark):
    offers, none = embed_inputs(spark)
    good = offers.where("job_id in ('j1', 'j2')")
    assert [r.job_id for r in embed_offers(good, none, hashing_factory(16), limit=1).collect()] == ["j2"]


def test_seekers_come_and_go(spark):
    seekers = spark.createDataFrame(
        [("u1", ["welding", "sql"], ["DE", "MLE"]), ("u2", ["drafting"], ["Dev"]), ("u3", None, ["x"])],
        "user_id string, skills array<string>, job_titles array<string>",
    )
    previous = spark.createDataFrame(
        [("u2", [1.0] * 16, [2.0] * 16), ("gone", [1.0] * 16, [1.0] * 16)], schemas.SEEKER_EMBEDS
    )
    got = {r.user_id: r for r in embed_seekers(seekers, previous, hashing_factory(16)).collect()}
    assert set(got) == {"u1", "u2"}
    assert got["u2"].avg_role_embeds == [2.0] * 16
    assert got["u1"].avg_role_embeds == pytest.approx(vector("DE", "MLE"), abs=1e-6)


def test_made_pages_get_tasks_by_their_number(spark, tmp_path, monkeypatch):
    """A small table of parts makes large pages, so its rows and not its bytes give the tasks."""
    from offerloom.bindings import pages

    spark.range(1_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert pages._spread_parts(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    monkeypatch.setattr(pages, "_TASK_PARTS", 90)
    spread = pages._spread_parts(spark, str(tmp_path))
    assert spread.rdd.getNumPartitions() == 12 and spread.distinct().count() == 1_000
