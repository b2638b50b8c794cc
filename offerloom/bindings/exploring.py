"""Profiles and frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.bindings import Bound, table, text_table
from offerloom.operators import profile


def top_values(spark: SparkSession, folder: str) -> DataFrame:
    """The 11 commonest brands, types and names of parts, in one pass."""
    part = table(spark, folder, "part")
    top = profile.top_values(part, ["p_brand", "p_type", "p_name"], 11)
    return top.select("column", "value", "n", F.col("place").cast("bigint").alias("place"))


def _counts_sql(name: str, columns: list[str], keep_null: bool = False) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM {name} "
        + ("" if keep_null else f"WHERE {c} IS NOT NULL ")
        + "GROUP BY ALL"
        for c in columns
    )


TOP_VALUES_SQL = f"""
SELECT "column", value, n, place FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place
  FROM ({_counts_sql('part', ['p_brand', 'p_type', 'p_name'])}))
WHERE place <= 11
"""


def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all documents, null counted as a value."""
    joined = table(spark, folder, "documents").select("doc_id", "lang", "source").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return profile.value_counts(joined, ["lang", "source", "quality", "toxic"], keep_null=True)


_LABELLED = "(SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
VALUE_COUNTS_SQL = _counts_sql(_LABELLED, ["lang", "source", "quality", "toxic"], True)


def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_values(
        table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]
    )


DISTINCT_VALUES_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", {c}::VARCHAR AS value FROM orders"
    for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
)

_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    lines = text_table(spark, folder, "lineitem")
    numbers = profile.numeric_profile(lines, list(_NUMERIC))
    rounded = [F.round(c, 5).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    return numbers.select("column", "n", *rounded)


PROFILE_NUMERIC_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 5) AS mean,
    round(stddev_samp({c}), 5) AS std, round(min({c})::DOUBLE, 5) AS min,
    round(quantile_cont({c}::DOUBLE, 0.25), 5) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 5) AS p50,
    round(quantile_cont({c}::DOUBLE, 0.75), 5) AS p75, round(max({c})::DOUBLE, 5) AS max
    FROM lineitem"""
    for c in _NUMERIC
)

_CATEGORIES = ("l_returnflag", "l_linestatus", "l_suppkey", "l_partkey")


def profile_categorical(spark: SparkSession, folder: str) -> DataFrame:
    return profile.categorical_profile(text_table(spark, folder, "lineitem"), list(_CATEGORIES))


PROFILE_CATEGORICAL_SQL = f"""
WITH counts AS ({_counts_sql('lineitem', list(_CATEGORIES))}),
peaks AS (
  SELECT "column", sum(n)::BIGINT AS n, count(*) AS "unique", max(n) AS freq FROM counts GROUP BY 1
)
SELECT p."column", p.n, p."unique", min(c.value) AS top, p.freq
FROM peaks p JOIN counts c ON p."column" = c."column" AND p.freq = c.n
GROUP BY ALL
"""


def _with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_nationkey") > 4, F.col("c_mktsegment")).alias("c_mktsegment"),
    )


_GAPS_SQL = """(SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
    CASE WHEN c_nationkey > 4 THEN c_mktsegment END AS c_mktsegment FROM customer)"""
_GAP_COLS = ("c_custkey", "c_acctbal", "c_mktsegment")


def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.null_counts(_with_gaps(spark, folder))


NULL_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null "
    f"FROM {_GAPS_SQL}"
    for c in _GAP_COLS
)


def null_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return profile.null_matrix(_with_gaps(spark, folder), keep=["c_custkey"])


NULL_MATRIX_SQL = f"""
SELECT c_custkey, c_acctbal IS NULL AS c_acctbal, c_mktsegment IS NULL AS c_mktsegment
FROM {_GAPS_SQL}
"""


def table_shape(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_shape(_with_gaps(spark, folder))


TABLE_SHAPE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(*) AS n_rows "
    f"FROM {_GAPS_SQL}"
    for c, t in zip(_GAP_COLS, ("bigint", "double", "string"))
)

QUERIES = {
    "top_values": Bound(top_values, TOP_VALUES_SQL),
    "value_counts": Bound(value_counts, VALUE_COUNTS_SQL),
    "distinct_values": Bound(distinct_values, DISTINCT_VALUES_SQL),
    "profile_numeric": Bound(profile_numeric, PROFILE_NUMERIC_SQL),
    "profile_categorical": Bound(profile_categorical, PROFILE_CATEGORICAL_SQL),
    "null_counts": Bound(null_counts, NULL_COUNTS_SQL),
    "null_matrix": Bound(null_matrix, NULL_MATRIX_SQL),
    "table_shape": Bound(table_shape, TABLE_SHAPE_SQL),
}
