"""Exact dedup, centroid clustering and periodic runs against plain versions and awkward rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("offerloom.llm")

from offerloom.llm import common, content_sort, lookup_clusters, periodic_runs
from offerloom.llm.bindings import QUERIES

FOLDER = "/root/testdata/sf0.001"
CLASHES = "row long, id long, norm string, mark long, head string, piece long, pieces long, place long, first long, size long, kept long, own long"


def squeezed(text):
    out, gap = [], False
    for c in text or "":
        space = c in " \t\n\x0b\x0c\r"
        if not (space and gap):
            out.append(" " if space else c)
        gap = space
    return "".join(out)


@pytest.fixture(scope="module")
def copies(spark):
    """Nulls, white space, repeated rows, a large group, long texts, clashing column names."""
    long = "word " * 40_000
    rows = [(1, None), (2, ""), (3, " "), (4, "\t\r\n\x0b\x0c "), (5, "a  b"), (6, "a b"), (6, "a b"), (7, "a\xa0b"), (8, "a\x1cb"),
            (None, "a\nb"), (None, "only null"), (None, "only null"), (9, long), (10, long + " "), (11, long + "x"), (12, " a b"), (13, "a b ")]
    rows += [(100 + i, "the same  text" if i % 2 else "the same\ntext") for i in range(300)]
    return spark.createDataFrame([(*r, *[7] * 2, "x", 7, "x", *[7] * 7) for r in rows], f"doc_id long, text string, {CLASHES}")


def answer(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(squeezed(text), []).append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece_rows, piece_bytes", [(4096, 16 << 20), (40, 16 << 20), (1, 1), (4096, 100_000)])
def test_copies_against_plain_version(spark, copies, piece_rows, piece_bytes):
    rows = copies.collect()
    found = content_sort.marked_copies(copies, None, piece_rows, piece_bytes).drop("row")
    got = [(r.id, r.keep_id, r.size, r.kept, r.sha256) for r in found.collect()]
    assert sorted(got, key=repr) == answer([(r.doc_id, r.text) for r in rows])


def test_kept_rows_keep_their_columns(spark, copies):
    found = content_sort.without_copies(copies)
    assert found.columns == copies.columns
    texts = [squeezed(r.text) for r in found.collect()]
    assert sorted(texts) == sorted({squeezed(r.text) for r in copies.collect()})
    assert all(r["mark"] == 7 and r["head"] == "x" for r in found.collect())
    assert content_sort.copy_groups(copies.limit(0)).count() == 0 and content_sort.without_copies(copies.limit(0)).count() == 0


def test_content_sort_moves_texts_once(spark):
    plan = content_sort.copy_groups(common.documents(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan


def clusters(rows, dim, scale, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(x))) for x in v]))
    seed = lambda r: ("g" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(kept, key=seed)[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        parts = {}
        for _, v in kept:
            parts.setdefault(nearest(v)[1], []).append(v)
        for j, members in parts.items():
            centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = {j: sum(d for _, c, d in out if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, own[c], sum(own.values()), digest[c]) for i, c, d in out], key=repr)


@pytest.mark.parametrize("few", [False, True])
def test_clusters_against_plain_version(spark, few):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 40 if i % 5 else 0.2, 6).tolist()) for i in range(3 if few else 300)]
    rows += [(7, None), (8, []), (9, [1.0] * 5), (10, [None] + [1.0] * 5), (11, [float("nan")] + [1.0] * 5), (12, [float("inf")] * 6)]
    rows += [] if few else [(None, [0.5] * 6), (None, [0.25] * 6), (20, [0.5] * 6), (20, [0.5] * 6)] + [(1000 + i, [3.0] * 6) for i in range(200)]
    table = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "vec_id long, embedding array<float>, id long, cluster long, vec long")
    exact = [(r.vec_id, r.embedding) for r in table.collect()]
    got = [tuple(r) for r in lookup_clusters.cluster_vectors(table.repartition(3), 6, 64, 16, 3).collect()]
    assert sorted(got, key=repr) == clusters(exact, 6, 64, 16, 3)


def test_clusters_of_nothing_and_of_huge_components(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<double>")
    assert lookup_clusters.cluster_vectors(table.limit(0), 2).count() == 0
    assert lookup_clusters.cluster_vectors(table, 64).count() == 0
    assert [tuple(r)[:5] for r in lookup_clusters.cluster_vectors(table, 2).collect()] == [(1, 0, 0, 0, 0)]
    huge = spark.createDataFrame([(1, [1e30, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="may not fit a long"):
        lookup_clusters.cluster_vectors(huge, 2).count()


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            end = i
            while end < n and w[end] == w[end - q]:
                end += 1
            start, length = i - q, end - i + q
            if end > i and length >= max(6, 4 * q):
                part = w[start:end]
                if all(any(part[t] != part[t - p] for t in range(p, length)) for p in range(1, q)):
                    out.add((start, length, q))
            i = max(end, i + 1)
    return sorted(out)


def test_runs_against_plain_version():
    rng, found = random.Random(5), 0
    for n in range(3_000):
        words = []
        while len(words) < n % 150:
            base = [rng.randint(0, rng.choice([1, 2, 6])) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 13]))]
            if rng.random() < 0.3:
                base = (base[:2] * len(base))[: len(base)] + [9]
            words += (base * 10)[: rng.randint(1, 8 * len(base))]
        expected = plain_runs(words)
        assert periodic_runs.runs_of(np.array(words, np.int64)) == expected, words
        found += len(expected)
    assert found > 3_000


def test_runs_of_very_long_periodic_texts():
    one = periodic_runs.runs_of(np.zeros(100_000, np.int64))
    two = periodic_runs.runs_of(np.tile([0] * 50 + [1], 1_000))
    assert one == [(0, 100_000, 1)]
    assert (0, 51_000, 51) in two and len(two) == 1_001


def run_row(i, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
    names = {}
    runs = plain_runs([names.setdefault(w, len(names)) for w in words])
    gone = {j for s, length, q in runs for j in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    written = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
    milli = best[1] * 1000 // best[2] if runs else None
    return (i, len(runs), *best, milli, hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_digests_against_plain_version(spark):
    table = common.documents(spark, FOLDER)
    rows = [(r.doc_id, r.text) for r in table.where("length(text) < 6000").collect()]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"].run(spark, FOLDER).collect()}
    assert len(got) == table.count() and len(rows) > 100
    expected = [run_row(*r) for r in rows]
    assert [got[i] for i, _ in rows] == expected and sum(r[1] for r in expected) > 5


def test_runs_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (5, "a\xa0b a\xa0b a\xa0b a\xa0b a\xa0b a\xa0b end"), (None, "x y x y x y x y"),
            *[(i, "one two three four five six seven") for i in range(10, 60)], (6, "x\x1cy " * 8), (4, "a a a a a a"), (7, "ab " * 9_000)]
    table = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "doc_id long, text string, id long, words long, runs long")
    got = sorted((tuple(r) for r in periodic_runs.run_digests(table).collect()), key=repr)
    expected = sorted((run_row(i, t if i != 7 else None) for i, t in rows), key=repr)
    assert [r for r in got if r[0] != 7] == [r for r in expected if r[0] != 7]
    assert [r[1] for r in got if r[0] == 7] == [1]
    assert periodic_runs.run_digests(table.limit(0)).count() == 0


ALONE = "nothing like the others in this table here"
A = " ".join(f"a{i}" for i in range(60))
NEAR = " ".join(f"a{i}" for i in range(4, 60))
B = " ".join(f"a{i}" for i in range(8, 60))


def kept(spark, rows):
    from offerloom.llm import jaccard_join

    names = "doc_id long, text string, row long, whole long, stays long, own_row long, gone_id long, `class` long"
    table = spark.createDataFrame([(*r, *[7] * 6) for r in rows], names)
    found = jaccard_join.one_of_each_group(table)
    assert found.columns == table.columns
    out = found.collect()
    assert all(tuple(r)[2:] == (7,) * 6 for r in out)
    return sorted(((r.doc_id, r.text) for r in out), key=repr)


def test_groups_keep_one_row_and_lose_no_other(spark):
    assert kept(spark, [(1, A), (2, A), (2, ALONE)]) == [(1, A), (2, ALONE)]
    assert kept(spark, [(5, A), (5, A), (None, A), (None, A)]) == [(5, A)]
    assert kept(spark, [(None, A), (None, A), (None, None), (None, None), (3, ""), (3, "")]) == [
        (3, ""), (3, ""), (None, A), (None, None), (None, None)]
    assert len(kept(spark, [(4, A), (4, NEAR), (4, ALONE), (4, ALONE)])) == 2
    assert kept(spark, []) == []


@pytest.mark.parametrize("middle", [3, None])
def test_links_through_a_null_id(spark, middle):
    from offerloom.llm import jaccard_join

    table = spark.createDataFrame([(1, A), (middle, NEAR), (2, B)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table, 4, 85, 100).collect()}
    assert got == {1: 1, middle: 1, 2: 1}


def test_families_under_one_passage(spark):
    """Many families of near copies that share a passage: all pairs, and few rows told twice."""
    from offerloom.llm import jaccard_join

    rng = random.Random(8)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for f in range(40):
        own = [f"f{f}w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 90, 400]))]
        for m in range(3):
            words = passage + own
            for _ in range(rng.randint(0, 12)):
                words[rng.randrange(len(words))] = f"e{f}{m}{rng.random()}"
            rows.append((10 * f + m, " ".join(words)))
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table, 4, 85, 100).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(sets)


def test_pairs_of_large_sets_are_told_once(spark):
    """Sets of hundreds of keys that share many meet in one row for each pair, and no pair is lost."""
    from pyspark.sql import functions as F
    from offerloom.llm import jaccard_join

    rng = random.Random(3)
    held = {c: set(rng.sample(range(-500, 500), 400)) for c in range(6)} | {6: {499, 7}, 7: {498, 499}, 8: {7}}
    named = spark.createDataFrame([(c, k) for c, keys in held.items() for k in keys], "class long, key long")
    named = jaccard_join._with_earlier(named)
    assert named.agg(F.max(F.size("earlier"))).first()[0] == jaccard_join.FIRST_KEYS
    other = named.select(*[F.col(c).alias(f"b_{c}") for c in named.columns])
    met = named.join(other, (F.col("key") == F.col("b_key")) & (F.col("class") < F.col("b_class")) & ~F.arrays_overlap("earlier", "b_earlier"))
    pairs = [(r["class"], r.b_class) for r in met.collect()]
    assert set(pairs) == {(a, b) for a in held for b in held if a < b and held[a] & held[b]}
    assert len(pairs) < 1.2 * len(set(pairs))


def test_internal_names_as_columns(spark):
    """Columns named like those used inside pass through mixing, line dedup and language."""
    from offerloom.llm import language_id, line_dedup, mixing

    names = ("target epochs cut source_size mix_source mix_size mix_key mix_order mix_row mix_copy gone own_row own_key lines whole "
             "has_letter row pos h norm sim first copies root part").split()
    rows = [(i, "a line of words that repeats\nand line %d" % i, "s", *[100 + i] * len(names)) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))

    def carried(df):
        return [n for n in names if any(r[n] != 100 + r.doc_id for r in df.collect())]

    assert carried(mixing.mixed_documents(table)) == [] and mixing.mixed_documents(table).columns == table.columns
    cleaned = line_dedup.without_repeated_lines(table)
    assert carried(cleaned) == [] and sum(r.n_dropped for r in cleaned.collect()) >= 5
    found = language_id.with_language(table, None)
    assert carried(found) == [] and found.columns == [*table.columns, "lang_pred", "lang_score"]


def test_many_lines_of_one_text(spark):
    from offerloom.llm import line_dedup

    lines = [hashlib.sha256(str(i % 3_000).encode()).hexdigest() for i in range(6_000)]
    table = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = line_dedup.without_repeated_lines(table).collect()[0]
    assert (got.n_lines, got.n_dropped) == (6_000, 3_000) and got.text.split("\n") == lines[:3_000]
