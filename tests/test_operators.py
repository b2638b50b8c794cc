import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from offerloom.operators import profile, tagging
from offerloom.operators.dedupe import (
    distinct_at_first_position,
    keep_first,
    keep_first_in_sequence,
    upsert,
)
from offerloom.operators.filters import not_listed
from offerloom.operators.language import english_flags
from offerloom.operators.pooling import pool
from offerloom.operators.ranking import row_number_in_groups
from offerloom.operators.sizing import broadcast_if_small, fits, rows_if_small
from offerloom.operators.membership import may_hold, member_bits, member_hash
from offerloom.operators.skew import grid_cuts, grid_join, key_sizes, salted_join


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("long_keys", [False, True])
def test_keep_first_treats_nulls_as_equal_and_is_idempotent(spark, long_keys):
    df = spark.createDataFrame(
        [("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, pos int"
    )
    once = keep_first(df, ["k"], [F.col("pos")], long_keys)
    assert rows(once) == [("a", 1), ("b", 5), (None, 3)]
    assert rows(keep_first(once, ["k"], [F.col("pos")], long_keys)) == rows(once)


def test_keep_first_reduces_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("pos"))
    plan = keep_first(df, ["k"], [F.col("pos")])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_sequence_differs_from_composite_key(spark):
    df = spark.createDataFrame(
        [("l1", "d1", 1), ("l1", "d2", 2), ("l2", "d1", 3), ("l3", "d2", 4)],
        "link string, description string, pos int",
    )
    got = keep_first_in_sequence(df, [["link"], ["description"]], [F.col("pos")])
    assert rows(got) == [("l1", "d1", 1), ("l3", "d2", 4)]


def test_upsert_new_wins_and_keeps_the_rest(spark):
    new = spark.createDataFrame([(1, "new"), (3, "new")], "id int, v string")
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    assert rows(upsert(new, old, ["id"])) == [(1, "new"), (2, "old"), (3, "new")]


def test_dictionary_cleanup(spark):
    df = spark.createDataFrame([(3, "java"), (1, "sql"), (0, "java")], "pos int, skill string")
    assert rows(distinct_at_first_position(df, "skill", "pos")) == [(0, "java"), (1, "sql")]


@pytest.mark.parametrize("rows_per_salt", [5, 10_000])
def test_salted_join_equals_plain_join(spark, rows_per_salt):
    rng = random.Random(3)
    keys = ["hot"] * 60 + ["warm"] * 20 + [None] * 10 + ["cold", "lost"]
    big = spark.createDataFrame(
        [(i, k, rng.choice("xy")) for i, k in enumerate(keys)], "id int, k string, m string"
    )
    other = spark.createDataFrame(
        [(k, m, f"{k}{m}{i}") for k in ("hot", "warm", "cold", None) for m in "xy" for i in (1, 2)],
        "k string, m string, tag string",
    )
    got = salted_join(big, other, ["k", "m"], "id", rows_per_salt).select("id", "k", "m", "tag")
    right = other.select(F.col("k").alias("k2"), F.col("m").alias("m2"), "tag")
    plain = big.join(
        right, F.col("k").eqNullSafe(F.col("k2")) & F.col("m").eqNullSafe(F.col("m2"))
    ).select("id", "k", "m", "tag")
    assert rows(got) == rows(plain)
    assert got.count() == 2 * 91


def test_row_numbers_of_a_group_over_many_tasks(spark):
    rng = random.Random(5)
    data = [
        ("hot" if i % 5 else rng.choice("bc"), rng.choice([None, 1, 2]), rng.choice([0.1, 0.5]), i)
        for i in range(3000)
    ]
    df = spark.createDataFrame(data, "g string, day int, score double, id int")
    order = [F.desc_nulls_last("day"), F.desc("score"), F.col("id")]
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = row_number_in_groups(df, "g", order, "n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows(got.select(*plain.columns)) == rows(plain)


def test_excluded_list_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert rows(df.where(not_listed(F.col("c"), ["a"]))) == [("b",), (None,)]
    assert df.where(not_listed(F.col("c"), [])).count() == 3


WORDS = ["this", "is", "a", "simple", "english", "sentence", "hello", "world", "the", "Paris"]
CASES = [
    ("This is a simple English sentence.", 0.6, True),
    ("This is a simple English bonjour", 0.6, True),
    ("12345 67890", 0.6, False),
    ("", 0.6, False),
    (None, 0.6, False),
    ("hello world", 0.5, True),
    ("nihao world", 0.51, False),
    ("paris", 0.5, False),
    ("año_nuevo", 0.1, False),
]


@pytest.mark.parametrize("text, threshold, expected", CASES)
def test_language_ratio(spark, text, threshold, expected):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    df = spark.createDataFrame([("j", text)], "job_id string, description string")
    flag = english_flags(df, "job_id", "description", words, threshold).first()
    assert flag.is_english is expected
    assert (flag.n_tokens == 0) == (not text)


TERMS = [(0, "python"), (1, "java"), (2, "machine learning"), (3, "R"), (4, "é"), (5, "java"),
         (6, "a"), (7, "script and more")]
TEXTS = [(1, "JavaScript and Python"), (2, "Café"), (3, ""), (4, None),
         (5, "machine  learning"), (6, "Machine Learning in java script and more")]


def expected_tags(text):
    return None if text is None else [t for _, t in TERMS if t in text.lower()]


@pytest.mark.parametrize("route", ["scan", "automaton", "join"])
def test_tag_routes_agree(spark, monkeypatch, route):
    if route == "automaton":
        monkeypatch.setattr(tagging, "SCAN_TERMS", 0)
    if route == "join":
        monkeypatch.setattr(tagging, "BOUNDED_TERMS", 0)
    terms = spark.createDataFrame(TERMS, "pos bigint, skill string")
    df = spark.createDataFrame(TEXTS, "id int, text string")
    got = {r.id: r.skills for r in tagging.with_tags(df, "id", "text", terms).collect()}
    assert got == {i: expected_tags(t) for i, t in TEXTS}


@pytest.mark.parametrize("bounded, library", [(200_000, True), (0, True), (200_000, False)])
def test_tags_of_repeated_and_null_ids(spark, monkeypatch, bounded, library):
    monkeypatch.setattr(tagging, "SCAN_TERMS", 0)
    monkeypatch.setattr(tagging, "BOUNDED_TERMS", bounded)
    if not library:
        monkeypatch.setattr(tagging, "ahocorasick", None)
    terms = spark.createDataFrame([(0, "java"), (1, "python"), (2, "dev")], "pos bigint, skill string")
    df = spark.createDataFrame([(1, "Java dev"), (1, "Python"), (None, "java"), (None, None)], "id int, text string")
    got = sorted((str(r.id), r.text or "", r.skills) for r in tagging.with_tags(df, "id", "text", terms).collect())
    assert got == [("1", "Java dev", ["java", "dev"]), ("1", "Python", ["python"]), ("None", "", None), ("None", "java", ["java"])]


def test_null_groups_are_numbered(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    got = {(r.g, r.v): r.n for r in row_number_in_groups(df, "g", [F.col("v")], "n").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}


def test_tags_with_the_empty_term_and_no_terms(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, text string")
    for terms, expected in (([(0, "")], [""]), ([], [])):
        table = spark.createDataFrame(terms, "pos bigint, skill string")
        got = {r.id: r.skills for r in tagging.with_tags(df, "id", "text", table).collect()}
        assert got == {1: expected, 2: None}


def test_pool_is_the_mean(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "k string, v array<double>"
    )
    assert rows(pool(df, "k", "v")) == [("a", [2.0, 4.0]), ("b", [5.0, 5.0])]


def test_size_checks(spark):
    df = spark.createDataFrame([("abc",), ("de",)], "w string")
    assert fits(df, 2, 5, ("w",)) and not fits(df, 1, 5, ("w",)) and not fits(df, 2, 4, ("w",))
    assert rows_if_small(df, 1) is None and len(rows_if_small(df, 2)) == 2
    hinted = broadcast_if_small(df)._jdf.queryExecution().logical().toString()
    plain = broadcast_if_small(df, max_rows=1)._jdf.queryExecution().logical().toString()
    assert "Hint" in hinted and "Hint" not in plain


@pytest.mark.parametrize("shape", ["normal", "constant", "skewed", "tiny"])
def test_exact_quantiles(spark, shape):
    rng = np.random.default_rng(11)
    data = {
        "normal": rng.normal(size=5000),
        "constant": np.full(500, 3.5),
        "skewed": np.where(rng.random(5000) < 0.4, 7.0, rng.lognormal(size=5000)),
        "tiny": np.array([2.0, 1.0]),
    }[shape]
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,)], "x double")
    got = {r.p: r.quantile for r in profile.exact_quantiles(df, ["x"]).collect()}
    for p in (0.25, 0.5, 0.75):
        assert got[p] == pytest.approx(np.quantile(data, p), rel=1e-12)


def test_columns_by_type(spark):
    df = spark.createDataFrame(
        [], "a string, b double, c int, d boolean, e date, f array<string>"
    )
    kinds = profile.columns_by_type(df)
    assert kinds == {
        "text": ["a"], "float": ["b"], "int": ["c"], "bool": ["d"], "date": ["e"], "other": ["f"]
    }


@pytest.mark.parametrize("cell_pairs, cell_rows", [(1, 1), (30, 7), (100, 1_000), (10**6, 10**6)])
def test_grid_join_equals_plain_join(spark, cell_pairs, cell_rows):
    rng = random.Random(4)
    keys = ["hot"] * 70 + ["warm"] * 9 + [None] * 12 + ["cold"]
    left = spark.createDataFrame([(i, k, rng.choice("xy")) for i, k in enumerate(keys)], "id int, k string, m string")
    right = spark.createDataFrame(
        [(i, k, rng.choice("xy")) for i, k in enumerate(["hot"] * 40 + ["warm", None, None, "lost"])], "tag int, k string, m string"
    )
    got = grid_join(left, right, ["k", "m"], "id", "tag", cell_pairs, cell_rows).select("id", "k", "m", "tag")
    plain = left.join(
        right.withColumnsRenamed({"k": "k2", "m": "m2"}), F.expr("k <=> k2 and m <=> m2")
    ).select("id", "k", "m", "tag")
    assert rows(got) == rows(plain)


def test_grid_cells_of_a_key_that_most_of_both_sides_have(spark):
    """No cell gives more than about the stated pairs, and both sides are cut."""
    left = spark.range(6_000).select(F.col("id").alias("l"), F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(3_000).select(F.col("id").alias("r"), F.when(F.col("id") % 10 < 8, 0).otherwise(-F.col("id")).alias("k"))
    cuts = grid_cuts(key_sizes(left, ["k"]), key_sizes(right, ["k"]), ["k"], 10_000, 1_000_000).collect()
    assert [(r.cut_rows, r.cut_columns) for r in cuts] == [(48, 24)]
    joined = grid_join(left, right, ["k"], "l", "r", 10_000)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    spread = joined.groupBy(F.pmod(F.xxhash64("l"), F.lit(48)).alias("i"), F.pmod(F.xxhash64("r"), F.lit(24)).alias("j")).count().collect()
    assert len(spread) == 48 * 24 and sum(r["count"] for r in spread) == 4_800 * 2_400
    assert max(r["count"] for r in spread) < 40_000


def test_member_bits(spark):
    values = spark.createDataFrame([(f"word{i}",) for i in range(3_000)] + [(None,)], "w string")
    bits = member_bits(values, "w")
    held = values.where("w is not null").where(~may_hold(member_hash(F.col("w")), bits)).count()
    others = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("w"))
    assert held == 0 and others.where(may_hold(member_hash(F.col("w")), bits)).count() < 1_000
    nothing = member_bits(values.where("w is null"), "w")
    assert others.where(may_hold(member_hash(F.col("w")), nothing)).count() == 0


def test_join_route_of_long_terms_and_texts(spark):
    """Terms beyond the carried length, texts beyond a stretch, hits across stretches, repeated texts."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 700, 3_000)]
    long = "x" * 10 + "y" * 80
    texts += [texts[6], None, "q" * 250 + long + "tail", "x" * 10 + "y" * 70, "Ünï çödé " * 60, "İstanbul"]
    terms = sorted({t[i : i + n] for t in texts[:8] for i in range(0, max(1, len(t) - 9), 97) for n in (1, 3, 6, 9)} | {long, "çödé ü", "nowhere", "i̇st"})
    terms = [*terms, ""]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "pos bigint, skill string")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.skills for r in tagging.with_tags(df, "id", "text", table, bounded_terms=0).collect()}
    lowered = {r.id: r.low for r in df.select("id", F.lower("text").alias("low")).collect()}
    assert got == {i: None if t is None else [s for s in terms if s in t] for i, t in lowered.items()}


def test_anchors_leave_the_scan_near_to_the_hits(spark):
    texts = spark.range(300).select(F.col("id").alias("key"), F.concat(F.repeat(F.lit("lorem ipsum dolor "), 40), F.lit("kubernetes")).alias("text"))
    anchors = spark.createDataFrame([("kubern",), ("python",), ("postgr",)], "anchor string")
    hits = tagging.anchor_hits(texts, anchors)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    # The filter's words are a constant by then, and nothing is shuffled before it.
    assert "from_json" not in plan and "Exchange" not in plan and 300 <= hits.count() < 320


def test_join_route_moves_one_row_for_each_tag(spark):
    """A text that repeats a term gives one row for it in a window, whatever follows the term."""
    texts = spark.range(50).select(
        F.col("id").alias("key"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.concat(F.lit("kubernetes "), i)), " ").alias("text")
    )
    anchors = spark.createDataFrame([("kubernetes",), ("kube",), ("és",), ("netes 49",)], "anchor string")
    hits = tagging.anchor_hits(texts, anchors)
    assert hits.count() < 200 and hits.distinct().count() == 150


@pytest.mark.parametrize("window", [7, 64, 1 << 16])
def test_substrings_in_windows(monkeypatch, window):
    """Members across windows are found, those across texts are not, and multi-byte ones are."""
    import pyarrow as pa

    from offerloom.operators import substrings

    monkeypatch.setattr(substrings, "WINDOW", window)
    members = ["a", "ñu", "logical", "a longer one", "xyz"]
    texts = ["", "a longer one", None, "lo", "gical ñu ñu", "zoological a longer oneañu", "xy", "z"]
    flat, bounds = substrings._flat(pa.array([m.encode() for m in members]))
    sums, sizes = substrings._Sums(flat, *substrings._tables(len(flat))), np.diff(bounds)
    first, whole = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
    for out, least, of in ((first, substrings.FIRST + 1, np.minimum(sizes, substrings.FIRST)), (whole, 0, sizes)):
        for h in sums.hashes(bounds[:-1], of)[sizes >= least].tolist():
            out[[h & 0xFFFFF, h >> 32 & 0xFFFFF]] = True
    data, bounds = substrings._flat(pa.array([t if t is None else t.encode() for t in texts], pa.binary()))
    found = set()
    for text, begin, size in substrings._found(data, bounds, sorted(set(sizes.tolist())), first, whole):
        found |= {(t, bytes(data[b : b + n]).decode()) for t, b, n in zip(text.tolist(), begin.tolist(), size.tolist())}
    assert found == {(i, m) for i, t in enumerate(texts) for m in members if t and m in t}
