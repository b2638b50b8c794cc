import random
import uuid
from datetime import date, datetime
from urllib.parse import quote_plus, urlencode, urlparse, urlunparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.functions.dates import is_recent, parse_timestamp, relative_date
from offerloom.functions.keys import BASE57, match_key, split_match_key, stable_key
from offerloom.functions.report import percent_text, plain_title, report_row
from offerloom.functions.text import (
    is_remote,
    parse_bool,
    parse_count,
    parse_number,
    squeeze,
)
from offerloom.functions.urls import canonical_url, form_encode, search_url, strip_query
from offerloom.functions.vectors import cosine_4dp, mean_vector, normalise, weighted_score


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def python_key(link):
    number, text = uuid.uuid5(uuid.NAMESPACE_DNS, link).int, ""
    while number:
        number, rest = divmod(number, 57)
        text = BASE57[rest] + text
    return text.rjust(22, BASE57[0])


def test_stable_key(spark):
    links = ["https://example.com/job1", "", "ñandú/Ω", "x" * 500, "a?b=1"]
    links += [f"https://example.com/{random.Random(1).random()}/{i}" for i in range(50)]
    assert column(spark, links, "string", stable_key) == [python_key(x) for x in links]


def test_match_key_round_trip(spark):
    df = spark.createDataFrame([("u1", "j1")], "u string, j string")
    key = df.select(match_key(F.col("u"), F.col("j")).alias("k"))
    assert key.first().k == "u1|j1"
    assert tuple(key.select(*split_match_key(F.col("k"))).first()) == ("u1", "j1")


def test_urls(spark):
    links = [
        "https://a.example/x;p=1/y;q=2?r=3#s", "HTTP://A.example/Path?x", "https://a.example",
        "/jobs/view/1?trk=2", "https://a.example/a#b?c", "no scheme;x", "",
    ]
    expected = []
    for link in links:
        parts = urlparse(link)
        expected.append(urlunparse((parts.scheme, parts.netloc, parts.path, "", "", "")))
    assert column(spark, links, "string", canonical_url) == expected
    assert column(spark, links, "string", strip_query) == [x.split("?")[0] for x in links]


def test_form_encoding(spark):
    texts = ["a b", "a+b", "~*-_.", "ñ&=?/:@", "C#", "100%"]
    assert column(spark, texts, "string", form_encode) == [quote_plus(t) for t in texts]


@pytest.mark.parametrize("start", [0, 25])
def test_search_url(spark, start):
    overrides = {"f_TPR": "r86400", "f_WT": "", "f_E": "3,4"}
    params = {
        "keywords": "Data Engineer ~*", "location": "Colombia", "geoId": "100876405",
        "start": start, "f_TPR": "r43200", "f_JT": "F", "f_WT": "2",
    }
    params.update(overrides)
    params = {k: v for k, v in params.items() if v}
    params["keywords"] = params["keywords"].replace(" ", "+")
    expected = "https://x.example/s?" + urlencode(params)
    got = column(
        spark, ["Data Engineer ~*"], "string",
        lambda v: search_url("https://x.example/s", v, F.lit(start), overrides),
    )
    assert got == [expected]


@pytest.mark.parametrize(
    "phrase, expected",
    [
        ("Hace 17 horas", "2024-03-09"),
        ("17 hours ago", "2024-03-09"),
        ("9 hours ago", "2024-03-10"),
        (" hace   3 días\n", "2024-03-07"),
        ("1 day ago", "2024-03-09"),
        ("hace 2 semanas", "2024-02-25"),
        ("2 weeks ago", "2024-02-25"),
        ("hace 1 mes", "2024-02-09"),
        ("3 months ago", "2023-12-11"),
        ("hace 45 minutos", "2024-03-10"),
        ("600 minutes ago", "2024-03-09"),
        ("hace 1 año", "2023-03-11"),
        ("2 years ago", "2022-03-11"),
        ("just now", "2024-03-10"),
        ("hace pocos días", "2024-03-10"),
        ("5 fortnights ago", "2024-03-10"),
        ("ago 5", "2024-03-10"),
        ("Promoted", "2024-03-10"),
        ("99999999999 years ago", "2024-03-10"),
        ("", "2024-03-10"),
        (None, "2024-03-10"),
    ],
)
def test_relative_date(spark, phrase, expected):
    got = column(spark, [phrase], "string", lambda v: relative_date(v, "2024-03-10 09:30:00"))
    assert got == [date.fromisoformat(expected)]


def test_recency_is_a_timestamp_comparison(spark):
    days = ["2024-03-03", "2024-03-04", "2024-03-03 09:00:00", "2024-03-03 08:59:59"]
    got = column(
        spark, days, "string",
        lambda v: is_recent(parse_timestamp(v), datetime(2024, 3, 10, 9), 7),
    )
    assert got == [False, True, True, False]


def test_lenient_and_strict_timestamps(spark):
    assert column(spark, ["soon"], "string", parse_timestamp) == [None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column(spark, ["soon"], "string", lambda v: parse_timestamp(v, strict=True))


def test_literals(spark):
    assert column(spark, ["True", "False", "yes", None], "string", parse_bool) == [
        True, False, None, None,
    ]
    assert column(spark, ["0.7", " 1 ", "x", None], "string", parse_number) == [0.7, 1.0, None, None]
    assert column(spark, ["1,234", " 7 ", "n/a", "", None], "string", parse_count) == [
        1234, 7, 0, 0, 0,
    ]
    assert column(spark, ["\n a b \t", ""], "string", squeeze) == ["a b", ""]


def test_remote_flag(spark):
    rows = [("fully REMOTE", "x"), ("x", "Remote dev"), ("x", "y"), (None, None), (None, "remote")]
    df = spark.createDataFrame(rows, "d string, t string")
    got = [r[0] for r in df.select(is_remote(F.col("d"), F.col("t"))).collect()]
    assert got == [True, True, False, False, True]


def test_percent_text_equals_python_formatting(spark):
    rng = random.Random(7)
    scores = [0.85, 0.62, 0.72345, 0.65125, 1.0, 0.0, -0.00001, -0.12345, 0.01005, 1.23456789]
    for _ in range(5000):
        weight = rng.choice([0.5, 0.7, 0.3, rng.random()])
        scores.append(
            round(rng.random(), 4) * weight + round(rng.random(), 4) * (1 - weight)
        )
    got = column(spark, scores, "double", percent_text)
    assert got == [f"{s * 100:.2f}%" for s in scores]


def test_report_row(spark):
    df = spark.createDataFrame(
        [("Sr. [AI] (x|y)", "https://a.example", 0.85, date(2024, 1, 15)), (None, None, None, None)],
        "t string, l string, s double, d date",
    )
    got = [r[0] for r in df.select(report_row(*[F.col(c) for c in "tlsd"])).collect()]
    assert got == ["| [Sr. AI xy](https://a.example) | 85.00% | 2024-01-15 |", "| []() | 0.00% |  |"]
    assert column(spark, ["a|b"], "string", plain_title) == ["ab"]


PAIRS = [
    ([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]),
    ([1.0, 2.0], [1.0, 2.0]),
    ([1.0, -1.0], [-1.0, 1.0]),
    ([1e-8, 2e-8], [3e-8, 1e-8]),
    ([1e8, 2e8], [3e8, 1e8]),
]


def test_cosine(spark):
    df = spark.createDataFrame(PAIRS, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine_4dp(F.col("a"), F.col("b"))).collect()]
    for value, (a, b) in zip(got, PAIRS):
        exact = np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
        assert value == pytest.approx(exact, abs=1e-4)
        assert value == round(value, 4)


def test_cosine_undefined_and_unequal(spark):
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert zero.select(cosine_4dp(F.col("a"), F.col("b"))).first()[0] is None
    for pair in (([1.0], [1.0, 2.0]), ([], [])):
        df = spark.createDataFrame([pair], "a array<double>, b array<double>")
        assert df.select(cosine_4dp(F.col("a"), F.col("b"), strict=False)).first()[0] is None
        with pytest.raises(Exception, match="equal length"):
            df.select(cosine_4dp(F.col("a"), F.col("b"))).collect()


def test_cosine_rounds_half_to_even(spark):
    df = spark.range(1).select(F.bround(F.lit(0.12345), 4), F.bround(F.lit(0.12355), 4))
    assert tuple(df.first()) == (0.1234, 0.1236)


def test_vector_helpers(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 6.0]],), ([[5.0, 5.0]],), ([],)], "v array<array<double>>"
    )
    assert [r[0] for r in df.select(mean_vector(F.col("v"))).collect()] == [
        [2.0, 4.0], [5.0, 5.0], None,
    ]
    unit = column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>", normalise)
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1] == [None, None]
    score = spark.range(1).select(weighted_score(F.lit(0.8), F.lit(0.4), F.lit(0.7))).first()[0]
    assert score == pytest.approx(0.68)
