"""Deduplication, upsert, filters, availability and the offers plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.bindings import Bound, table, text_table
from offerloom.bindings.texts import PART_WORDS_SQL, key_sql, part_words
from offerloom.functions.dates import day_text
from offerloom.functions.keys import stable_key
from offerloom.functions.urls import strip_query
from offerloom.operators.availability import (
    check_offers,
    expire_by_pages,
    with_check_results,
)
from offerloom.operators.dedupe import (
    distinct_at_first_position,
    keep_first,
    keep_first_in_sequence,
    upsert,
)
from offerloom.operators.filters import (
    drop_null_rows,
    exactly_days_ago,
    ids_missing_from,
    ids_present_in,
    last_days,
    not_listed,
    recent,
)
from offerloom.plans.offers import build_offers, title_extract, unusable_offers
from offerloom.schemas import OFFERS

AS_OF = "2024-01-25 09:00:00"


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    unique = keep_first(documents, ["text"], [F.col("doc_id")], long_keys=True)
    return unique.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


DEDUPE_FIRST_SQL = """
SELECT min(doc_id) AS doc_id, length(text) AS n_chars FROM documents GROUP BY text
"""

_LINE_COLS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
)


def dedupe_two_step(spark: SparkSession, folder: str) -> DataFrame:
    """Latest line per order, then latest per part among those."""
    lines = table(spark, folder, "lineitem").select(*_LINE_COLS, "l_shipdate")
    order = [F.desc("l_shipdate"), *[F.col(c) for c in _LINE_COLS]]
    unique = keep_first_in_sequence(lines, [["l_orderkey"], ["l_partkey"]], order)
    return unique.withColumn("l_shipdate", day_text(F.col("l_shipdate")))


DEDUPE_TWO_STEP_SQL = f"""
WITH one AS (
  SELECT {', '.join(_LINE_COLS)}, l_shipdate FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_shipdate DESC, {', '.join(_LINE_COLS)}) = 1
)
SELECT {', '.join(_LINE_COLS)}, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM one
QUALIFY row_number() OVER (PARTITION BY l_partkey
        ORDER BY l_shipdate DESC, {', '.join(_LINE_COLS)}) = 1
"""


def upsert_new_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Orders are the stored rows; totals of their lines are the new ones."""
    old = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), F.round("o_totalprice", 2).alias("amount"),
        F.lit("orders").alias("origin"),
    )
    new = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("key"))
        .agg(F.sum("l_quantity").alias("amount"))
        .withColumn("origin", F.lit("lineitem"))
    )
    return upsert(new, old, ["key"])


UPSERT_NEW_WINS_SQL = """
WITH new AS (SELECT l_orderkey AS key, sum(l_quantity) AS amount FROM lineitem GROUP BY 1)
SELECT key, amount, 'lineitem' AS origin FROM new
UNION ALL
SELECT o_orderkey, round(o_totalprice, 2), 'orders' FROM orders
WHERE o_orderkey NOT IN (SELECT key FROM new)
"""


def recent_offers(spark: SparkSession, folder: str) -> DataFrame:
    kept = recent(table(spark, folder, "events"), "ts", AS_OF, 7)
    return kept.select("event_id", day_text(F.col("ts")).alias("day"))


RECENT_OFFERS_SQL = f"""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events
WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
"""


def day_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the last three days, or of the day four days ago, one type left out."""
    day = F.col("ts").cast("date")
    near, exact = last_days(day, AS_OF, 3), exactly_days_ago(day, AS_OF, 4)
    kept = table(spark, folder, "events").where(
        (near | exact) & not_listed(F.col("event_type"), ["error"])
    )
    return kept.select("event_id", "event_type", near.alias("near"))


DAY_FILTERS_SQL = """
SELECT event_id, event_type, ts::DATE > DATE '2024-01-22' AS near FROM events
WHERE (ts::DATE > DATE '2024-01-22' OR ts::DATE = DATE '2024-01-21') AND event_type <> 'error'
"""


def exclude_list(spark: SparkSession, folder: str) -> DataFrame:
    company = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    customers = table(spark, folder, "customer").select("c_custkey", company.alias("company"))
    return customers.where(not_listed(F.col("company"), ["MACHINERY", "BUILDING"]))


EXCLUDE_LIST_SQL = """
SELECT c_custkey, company
FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS company FROM customer)
WHERE NOT coalesce(company IN ('MACHINERY', 'BUILDING'), false)
"""


def null_rows_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; rows without a label go."""
    joined = table(spark, folder, "documents").select("doc_id", "lang").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return drop_null_rows(joined, ["quality", "toxic"])


NULL_ROWS_DROPPED_SQL = """
SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality IS NOT NULL AND toxic IS NOT NULL
"""


def missing_ids(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return ids_missing_from(documents, table(spark, folder, "labels"), "doc_id")


MISSING_IDS_SQL = """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""


def prune_ids(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return ids_present_in(documents, table(spark, folder, "labels"), "doc_id")


PRUNE_IDS_SQL = """
SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
"""


def dictionary_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, lowercased and distinct, at their first document."""
    words = text_table(spark, folder, "documents").select(
        F.col("doc_id").alias("pos"), F.explode(F.split(F.lower("text"), " ")).alias("skill")
    )
    return distinct_at_first_position(words, "skill", "pos")


DICTIONARY_CLEANUP_SQL = """
SELECT min(pos) AS pos, skill
FROM (SELECT doc_id AS pos, unnest(string_split(lower(text), ' ')) AS skill FROM documents)
GROUP BY skill
"""


def _page_offers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pages as offers with a three-way state, and the same pages as captures."""
    pages = table(spark, folder, "pages")
    url = F.col("url")
    offers = pages.select(
        F.col("page_id").cast("string").alias("job_id"),
        F.when(~F.contains(url, F.lit("casino")), strip_query(url)).alias("link"),
        F.when(F.contains(url, F.lit("#")), F.lit(False))
        .when(F.contains(url, F.lit("?")), F.lit(True))
        .alias("available"),
    )
    captures = pages.where(~F.contains(url, F.lit(".example.net"))).select(
        "url",
        F.when(F.contains(url, F.lit(".html")), 404).otherwise(200).alias("status_code"),
        F.col("html").alias("body"),
        F.lit("2024-01-25 00:00:00").cast("timestamp_ntz").alias("fetched_at"),
    )
    return offers, captures


TAGS = ("für sch", "èç")
_CHECKS_SQL = """
offers AS (
  SELECT page_id::VARCHAR AS job_id,
         CASE WHEN NOT contains(url, 'casino') THEN split_part(url, '?', 1) END AS link,
         CASE WHEN contains(url, '#') THEN false WHEN contains(url, '?') THEN true END AS available
  FROM pages
), gone AS (
  SELECT DISTINCT split_part(url, '?', 1) AS link FROM pages
  WHERE NOT contains(url, '.example.net')
    AND (contains(url, '.html') OR contains(html, 'für sch') OR contains(html, 'èç'))
), checks AS (
  SELECT job_id, link IS NOT NULL AND coalesce(link NOT IN (SELECT link FROM gone), true)
                 AS available
  FROM offers WHERE coalesce(available, true)
)"""


def availability_checks(spark: SparkSession, folder: str) -> DataFrame:
    return check_offers(*_page_offers(spark, folder), TAGS)


AVAILABILITY_CHECKS_SQL = f"WITH {_CHECKS_SQL} SELECT job_id, available FROM checks"


def availability_states(spark: SparkSession, folder: str) -> DataFrame:
    offers, captures = _page_offers(spark, folder)
    return with_check_results(offers, check_offers(offers, captures, TAGS))


AVAILABILITY_STATES_SQL = f"""
WITH {_CHECKS_SQL}
SELECT o.job_id, o.link,
       CASE WHEN coalesce(o.available, true) THEN c.available ELSE false END AS available
FROM offers o LEFT JOIN checks c USING (job_id)
"""


def availability_update(spark: SparkSession, folder: str) -> DataFrame:
    offers, captures = _page_offers(spark, folder)
    return expire_by_pages(offers, captures, TAGS)


AVAILABILITY_UPDATE_SQL = f"""
WITH {_CHECKS_SQL}
SELECT o.job_id, o.link, true AS available
FROM offers o JOIN checks c USING (job_id)
WHERE coalesce(o.available, true) AND c.available
"""

_LINK = "https://jobs.example.com/view/"


def _document_offers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as raw offers; conversation turns and labelled documents as stored ones."""
    documents = text_table(spark, folder, "documents")
    age = F.floor(F.col("n_chars") / 400).cast("int")
    link = F.concat(F.lit(_LINK), "n_chars", F.lit("?ref="), "doc_id")
    as_of = F.lit("2024-01-25").cast("date")
    raw = documents.select(
        link.alias("link"),
        F.col("text").alias("description"),
        F.when(F.col("lang") == "de", "A Remote role").otherwise(F.col("lang")).alias(
            "vacancy_name"
        ),
        F.when(F.col("source") != "src3", F.col("source")).alias("company"),
        F.date_format(F.date_sub(as_of, age), "yyyy-MM-dd").alias("publication_date"),
        F.lit("2024-01-25").alias("scraping_date"),
    )
    stored_cols = {
        "skills": F.array(F.lit("stored")),
        "remote": F.lit(False),
        "available": F.lit(True),
        "scraping_date": F.lit("2024-01-20").cast("date"),
        "publication_date": F.lit("2024-01-24").cast("date"),
    }
    labelled = documents.join(table(spark, folder, "labels"), "doc_id").select(
        stable_key(link).alias("job_id"),
        F.concat(F.lit(_LINK), "n_chars").alias("link"),
        F.col("text").alias("description"),
        F.lit("old").alias("vacancy_name"),
        F.lit("src-old").alias("company"),
    )
    turns = table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("job_id"),
        F.concat(F.lit(_LINK), F.length("text")).alias("link"),
        F.col("text").alias("description"),
        F.col("role").alias("vacancy_name"),
        F.when(F.col("role") != "system", F.col("role")).alias("company"),
    )
    stored = labelled.unionByName(turns).withColumns(stored_cols)
    for field in OFFERS.fields:
        if field.name not in stored.columns:
            stored = stored.withColumn(field.name, F.lit(None).cast(field.dataType))
    return raw, stored.select(*OFFERS.fieldNames())


def offers_plan(spark: SparkSession, folder: str) -> DataFrame:
    raw, stored = _document_offers(spark, folder)
    built = build_offers(
        raw, stored, part_words(spark, folder), AS_OF, ["src1", "user"]
    )
    return built.select(
        "job_id",
        "link",
        "vacancy_name",
        "company",
        day_text(F.col("publication_date")).alias("publication_date"),
        "remote",
        F.array_join("skills", "|").alias("skills"),
        F.md5("description").alias("description_md5"),
        "available",
    )


def offers_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Raw offers put aside by reason; some documents lack a link, a text or a readable date."""
    raw, _ = _document_offers(spark, folder)
    size = F.length("description")
    spoilt = raw.withColumns(
        {
            "link": F.when(size % 3 != 0, F.col("link")),
            "description": F.when(size % 5 != 0, F.col("description")),
            "publication_date": F.when(size % 7 == 0, "soon").otherwise(F.col("publication_date")),
        }
    )
    return unusable_offers(spoilt).groupBy("reason").agg(F.count("record").alias("n"))


OFFERS_QUARANTINE_SQL = """
SELECT reason, count(*) AS n FROM (
    SELECT CASE WHEN coalesce(length(text) % 3 = 0, true) THEN 'link missing'
                WHEN coalesce(length(text) % 5 = 0, true) THEN 'description missing'
                WHEN length(text) % 7 = 0 THEN 'publication_date unreadable' END AS reason
    FROM documents
) WHERE reason IS NOT NULL GROUP BY reason
"""


_STORED_SQL = f"""
SELECT {key_sql(f"'{_LINK}' || n_chars || '?ref=' || doc_id")} AS job_id,
       '{_LINK}' || n_chars AS link, text AS description, 'old' AS vacancy_name,
       'src-old' AS company, DATE '2024-01-24' AS day, false AS remote, 'stored' AS skills,
       true AS available, 1 AS source_rank
FROM documents JOIN labels USING (doc_id)
UNION ALL
SELECT 'c' || conv_id || '-' || turn, '{_LINK}' || length(text), text, role,
       CASE WHEN role <> 'system' THEN role END, DATE '2024-01-24', false, 'stored', true, 1
FROM conversations
"""
OFFERS_PLAN_SQL = f"""
WITH {PART_WORDS_SQL}, dict AS (SELECT list(skill ORDER BY pos, skill) AS d FROM words),
raw AS (
  SELECT {key_sql(f"'{_LINK}' || n_chars || '?ref=' || doc_id")} AS job_id,
         '{_LINK}' || n_chars || '?ref=' || doc_id AS link, text AS description,
         CASE WHEN lang = 'de' THEN 'A Remote role' ELSE lang END AS vacancy_name,
         CASE WHEN source <> 'src3' THEN source END AS company,
         DATE '2024-01-25' - (n_chars // 400)::INTEGER AS day,
         contains(lower(text), 'remote') OR lang = 'de' AS remote,
         array_to_string(list_filter(d, lambda t: contains(lower(text), t)), '|') AS skills,
         NULL::BOOLEAN AS available, 0 AS source_rank
  FROM documents, dict
), stored AS ({_STORED_SQL}), merged AS (
  SELECT * FROM raw
  UNION ALL SELECT * FROM stored WHERE job_id NOT IN (SELECT job_id FROM raw)
), kept AS (
  SELECT * REPLACE (split_part(link, '?', 1) AS link) FROM merged
  WHERE NOT coalesce(company IN ('src1', 'user'), false)
    AND day >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
), by_link AS (
  SELECT * FROM kept QUALIFY row_number() OVER (
    PARTITION BY link ORDER BY day DESC, source_rank, job_id) = 1
), by_text AS (
  SELECT * FROM by_link QUALIFY row_number() OVER (
    PARTITION BY description ORDER BY day DESC, source_rank, job_id) = 1
)
SELECT job_id, link, vacancy_name, company, strftime(day, '%Y-%m-%d') AS publication_date,
       remote, skills, md5(description) AS description_md5, available
FROM by_text
"""


def title_description_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and texts of three sources."""
    offers = table(spark, folder, "documents").select(
        F.col("source").alias("industries"),
        F.col("lang").alias("vacancy_name"),
        F.col("text").alias("description"),
        F.lit("2024-01-25").cast("date").alias("publication_date"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("job_id"),
    )
    return title_extract(offers, ["src1", "src2", "src7"]).select(
        "vacancy_name", F.md5("description").alias("description_md5")
    )


TITLE_EXTRACT_SQL = """
SELECT lang AS vacancy_name, md5(text) AS description_md5 FROM documents
WHERE source IN ('src1', 'src2', 'src7')
"""

QUERIES = {
    "dedupe_first": Bound(dedupe_first, DEDUPE_FIRST_SQL),
    "dedupe_two_step": Bound(dedupe_two_step, DEDUPE_TWO_STEP_SQL),
    "upsert_new_wins": Bound(upsert_new_wins, UPSERT_NEW_WINS_SQL),
    "recent_offers": Bound(recent_offers, RECENT_OFFERS_SQL),
    "day_filters": Bound(day_filters, DAY_FILTERS_SQL),
    "exclude_list": Bound(exclude_list, EXCLUDE_LIST_SQL),
    "null_rows_dropped": Bound(null_rows_dropped, NULL_ROWS_DROPPED_SQL),
    "missing_ids": Bound(missing_ids, MISSING_IDS_SQL),
    "prune_ids": Bound(prune_ids, PRUNE_IDS_SQL),
    "dictionary_cleanup": Bound(dictionary_cleanup, DICTIONARY_CLEANUP_SQL),
    "availability_checks": Bound(availability_checks, AVAILABILITY_CHECKS_SQL),
    "availability_states": Bound(availability_states, AVAILABILITY_STATES_SQL),
    "availability_update": Bound(availability_update, AVAILABILITY_UPDATE_SQL),
    "offers_plan": Bound(offers_plan, OFFERS_PLAN_SQL),
    "offers_quarantine": Bound(offers_quarantine, OFFERS_QUARANTINE_SQL),
    "title_extract": Bound(title_description_extract, TITLE_EXTRACT_SQL),
}
