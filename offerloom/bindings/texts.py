"""Keys, flags, tags, language, dates, links and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.bindings import Bound, table, text_table
from offerloom.functions.dates import relative_date
from offerloom.functions.keys import BASE57, DNS_NAMESPACE_HEX, match_key, split_match_key, stable_key
from offerloom.functions.text import (
    any_contains_ci,
    parse_bool,
    parse_count,
    parse_number,
    tokens,
)
from offerloom.functions.urls import canonical_url, strip_query
from offerloom.operators.filters import language_allowed
from offerloom.operators.language import english_flags
from offerloom.operators.tagging import with_tags
from offerloom.plans.crawl import frontier


def key_sql(link: str) -> str:
    """DuckDB expression for the stable key of a link expression."""
    digest = f"sha1(unhex('{DNS_NAMESPACE_HEX}') || encode({link}))"
    number = f"""(substr({digest}, 1, 12) || '5' || substr({digest}, 14, 3)
        || translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
        || substr({digest}, 18, 15))::UUID::UHUGEINT"""
    powers = ", ".join(f"'{57**i}'::UHUGEINT" for i in range(21, -1, -1))
    return f"""array_to_string(list_transform([{powers}], lambda p:
        substr('{BASE57}', (({number}) // p % 57)::INTEGER + 1, 1)), '')"""


def stable_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", stable_key(F.col("url")).alias("job_id")
    )


STABLE_KEYS_SQL = f"SELECT page_id, {key_sql('url')} AS job_id FROM pages"


def keyword_flag(spark: SparkSession, folder: str) -> DataFrame:
    flag = any_contains_ci([F.col("text"), F.col("source")], "LICENSE")
    return text_table(spark, folder, "documents").select("doc_id", flag.alias("flagged"))


KEYWORD_FLAG_SQL = """
SELECT doc_id, coalesce(contains(lower(text), 'license'), false)
            OR coalesce(contains(lower(source), 'license'), false) AS flagged
FROM documents
"""


def _joined_tags(tagged: DataFrame) -> DataFrame:
    return tagged.select(
        "doc_id",
        F.size("skills").cast("bigint").alias("n_tags"),
        F.array_join("skills", "|").alias("tags"),
    )


def part_words(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary of the words in part names, at their first part."""
    words = table(spark, folder, "part").select(
        F.col("p_partkey").alias("pos"), F.explode(F.split("p_name", " ")).alias("skill")
    )
    return words.groupBy("skill").agg(F.min("pos").alias("pos"))


PART_WORDS_SQL = """
words AS (
  SELECT skill, min(pos) AS pos
  FROM (SELECT p_partkey AS pos, unnest(string_split(p_name, ' ')) AS skill FROM part)
  GROUP BY skill
)"""


def dictionary_tags(spark: SparkSession, folder: str) -> DataFrame:
    documents = text_table(spark, folder, "documents").select("doc_id", "text")
    return _joined_tags(with_tags(documents, "doc_id", "text", part_words(spark, folder)))


_TAGS_SQL = """
SELECT doc_id, len(tags) AS n_tags, array_to_string(tags, '|') AS tags
FROM (
  SELECT doc_id, list_filter(dict, lambda t: contains(low, t)) AS tags
  FROM (SELECT doc_id, lower(text) AS low FROM documents),
       (SELECT list(skill ORDER BY pos, skill) AS dict FROM words)
)"""
DICTIONARY_TAGS_SQL = f"WITH {PART_WORDS_SQL} {_TAGS_SQL}"


def benchmark_words(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("pos"), F.explode(tokens(F.col("text"))).alias("skill")
    )
    return listed.groupBy("skill").agg(F.min("pos").alias("pos"))


def dictionary_tags_large(spark: SparkSession, folder: str) -> DataFrame:
    documents = text_table(spark, folder, "documents").select("doc_id", "text")
    return _joined_tags(with_tags(documents, "doc_id", "text", benchmark_words(spark, folder)))


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
BENCHMARK_WORDS_SQL = f"""
words AS (
  SELECT skill, min(pos) AS pos
  FROM (SELECT item_id AS pos, unnest({_TOKENS}) AS skill FROM benchmark)
  GROUP BY skill
)"""
DICTIONARY_TAGS_LARGE_SQL = f"WITH {BENCHMARK_WORDS_SQL} {_TAGS_SQL}"


def dictionary_tags_unbounded(spark: SparkSession, folder: str) -> DataFrame:
    """The large dictionary on the route of one that no task could hold."""
    documents = text_table(spark, folder, "documents").select("doc_id", "text")
    words = benchmark_words(spark, folder)
    return _joined_tags(with_tags(documents, "doc_id", "text", words, bounded_terms=0))


def language_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Token and hit counts of every document, and whether a Spanish-only seeker sees it."""
    words = benchmark_words(spark, folder).select(F.col("skill").alias("word"))
    documents = text_table(spark, folder, "documents").select("doc_id", "text")
    flags = english_flags(documents, "doc_id", "text", words)
    shown = language_allowed(F.lit(False), F.col("is_english"))
    return flags.select("doc_id", "n_tokens", "n_hits", "is_english", shown.alias("shown"))


LANGUAGE_GATE_SQL = f"""
WITH {BENCHMARK_WORDS_SQL}, toks AS (
  SELECT doc_id, unnest({_TOKENS}) AS tok FROM documents
), counts AS (
  SELECT doc_id, count(tok) AS n_tokens, count(skill) AS n_hits
  FROM toks LEFT JOIN words ON tok = skill GROUP BY doc_id
)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_hits, 0) AS n_hits,
       coalesce(n_hits / nullif(n_tokens, 0) >= 0.6::DOUBLE, false) AS is_english,
       NOT coalesce(n_hits / nullif(n_tokens, 0) >= 0.6::DOUBLE, false) AS shown
FROM documents LEFT JOIN counts USING (doc_id)
"""


def relative_dates(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    phrase = (
        F.when(kind == "click", F.concat(F.lit(" Hace  "), amount, F.lit(" horas")))
        .when(kind == "view", F.concat(amount, F.lit(" days ago")))
        .when(kind == "purchase", F.concat(F.lit("hace "), amount, F.lit(" semanas")))
        .when(kind == "signup", F.concat(amount, F.lit(" Months ago")))
        .otherwise(F.concat(F.lit("Promoted "), amount))
    )
    day = relative_date(phrase, "2024-02-01 09:30:00")
    return table(spark, folder, "events").select(
        "event_id", F.date_format(day, "yyyy-MM-dd").alias("day")
    )


RELATIVE_DATES_SQL = """
WITH e AS (
  SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k,
         TIMESTAMP '2024-02-01 09:30:00' AS now
  FROM events
)
SELECT event_id, strftime(CASE event_type
    WHEN 'click' THEN now - to_hours(k)
    WHEN 'view' THEN now - to_days(k)
    WHEN 'purchase' THEN now - to_days(7 * k)
    WHEN 'signup' THEN now - to_days(30 * k)
    ELSE now END, '%Y-%m-%d') AS day
FROM e
"""


def frontier_urls(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    keywords = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat("c_name", F.lit(" ~*"), "c_mktsegment").alias("role"),
        F.col("n_name").alias("country"),
    )
    extra = {"f_TPR": "r86400", "f_WT": "", "f_E": "3 & 4"}
    return frontier(keywords, "https://example.com/search", extra)


FRONTIER_URLS_SQL = """
SELECT c_name || ' ~*' || c_mktsegment AS role, n_name AS country,
       'https://example.com/search?keywords=' ||
       replace(url_encode(replace(c_name || ' ~*' || c_mktsegment, ' ', '+')), '*', '%2A') ||
       '&location=Colombia&geoId=100876405&f_TPR=r86400&f_JT=F&f_E=3+%26+4' AS url
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def url_strip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", strip_query(F.col("url")).alias("link")
    )


URL_STRIP_SQL = "SELECT page_id, split_part(url, '?', 1) AS link FROM pages"


def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", canonical_url(F.col("url")).alias("link")
    )


URL_CANONICAL_SQL = r"""
SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', '') AS link
FROM pages
"""


def parsed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Prices written with thousands separators, or as words, read back."""
    text = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(
        F.concat(F.lit("  "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" "))
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", parse_count(text).cast("bigint").alias("n")
    )


PARSED_COUNTS_SQL = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE floor(o_totalprice)::BIGINT END AS n
FROM orders
"""


def parsed_literals(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.when(F.col("c_acctbal") > 5000, "True").when(F.col("c_acctbal") > 0, "False")
    return table(spark, folder, "customer").select(
        "c_custkey",
        parse_bool(F.coalesce(flag, F.lit("maybe"))).alias("flag"),
        parse_number(
            F.when(F.col("c_mktsegment") == "BUILDING", F.lit("x")).otherwise(
                F.concat(F.lit(" "), F.col("c_nationkey"), F.lit(".5"))
            )
        ).alias("number"),
    )


PARSED_LITERALS_SQL = """
SELECT c_custkey,
       CASE WHEN c_acctbal > 5000 THEN true WHEN c_acctbal > 0 THEN false END AS flag,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey + 0.5::DOUBLE END AS number
FROM customer
"""


def match_key_split(spark: SparkSession, folder: str) -> DataFrame:
    keyed = table(spark, folder, "orders").select(
        match_key(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias(
            "match_id"
        )
    )
    user, job = split_match_key(F.col("match_id"))
    return keyed.select("match_id", user.alias("user_id"), job.alias("job_id"))


MATCH_KEY_SPLIT_SQL = """
SELECT o_custkey || '|' || o_orderkey AS match_id, o_custkey::VARCHAR AS user_id,
       o_orderkey::VARCHAR AS job_id
FROM orders
"""

QUERIES = {
    "stable_key": Bound(stable_keys, STABLE_KEYS_SQL),
    "keyword_flag": Bound(keyword_flag, KEYWORD_FLAG_SQL),
    "dictionary_tags": Bound(dictionary_tags, DICTIONARY_TAGS_SQL),
    "dictionary_tags_large": Bound(dictionary_tags_large, DICTIONARY_TAGS_LARGE_SQL),
    "dictionary_tags_unbounded": Bound(dictionary_tags_unbounded, DICTIONARY_TAGS_LARGE_SQL),
    "language_gate": Bound(language_gate, LANGUAGE_GATE_SQL),
    "relative_dates": Bound(relative_dates, RELATIVE_DATES_SQL),
    "frontier_urls": Bound(frontier_urls, FRONTIER_URLS_SQL),
    "url_strip": Bound(url_strip, URL_STRIP_SQL),
    "url_canonical": Bound(url_canonical, URL_CANONICAL_SQL),
    "parsed_counts": Bound(parsed_counts, PARSED_COUNTS_SQL),
    "parsed_literals": Bound(parsed_literals, PARSED_LITERALS_SQL),
    "match_key_split": Bound(match_key_split, MATCH_KEY_SPLIT_SQL),
}
