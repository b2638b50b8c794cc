"""Record files and tables: JSON in, versioned Parquet between stages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.operators.dedupe import distinct_at_first_position

CORRUPT = "_corrupt_record"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def is_missing_path(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def spread_scan(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than there are cores.

    A file with a single row group is one task however many cores are free. Large
    inputs have more splits than cores and pass through unchanged. ``df`` must be a
    plain scan, so that counting its partitions runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    lines: bool = False,
    keep_corrupt: bool = False,
) -> DataFrame:
    """JSON records with a stated schema; a missing path gives an empty table.

    A file holding one JSON array cannot be split, so large feeds should come as
    many files or as one record per line (``lines``). ``keep_corrupt`` adds the text
    of unreadable records for quarantine; otherwise such records are dropped.
    """
    extra = [T.StructField(CORRUPT, T.StringType())] if keep_corrupt else []
    full = T.StructType([*schema.fields, *extra])
    mode = "PERMISSIVE" if keep_corrupt else "DROPMALFORMED"
    try:
        return (
            spark.read.schema(full)
            .option("multiLine", not lines)
            .option("mode", mode)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .json(path)
        )
    except AnalysisException as error:
        if is_missing_path(error):
            return empty(spark, full)
        raise


def split_unreadable(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable records of ``keep_corrupt``, and ``(reason, record)`` of the others.

    A reader may check only the columns that a query asks for, so ``records`` should be
    persisted: then all queries see the same rows as unreadable.
    """
    bad = records.where(F.col(CORRUPT).isNotNull())
    return (
        records.where(F.col(CORRUPT).isNull()).drop(CORRUPT),
        bad.select(F.lit("record unreadable").alias("reason"), F.col(CORRUPT).alias("record")),
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet table with a stated schema; a missing path gives an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if is_missing_path(error):
            return empty(spark, schema)
        raise


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """JSON records with inferred types, for exploration."""
    return spark.read.option("multiLine", True).json(path)


def write_records(df: DataFrame, path: str) -> None:
    """Replace a JSON record folder; never the one ``df`` is read from."""
    df.write.mode("overwrite").json(path)


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """Skill dictionary as ``(pos, skill)`` from either on-disk shape.

    The shapes are ``{"skills": [...]}`` and ``{"skills": {"0": ...}}``. As text the
    two differ in their first character, which picks the parser.
    """
    text = spark.read.option("wholetext", True).text(path)
    skills = F.get_json_object("value", "$.skills")
    listed = text.where(F.startswith(F.ltrim(skills), F.lit("["))).select(
        F.posexplode(F.from_json(skills, "array<string>")).alias("pos", "skill")
    )
    keyed = text.where(F.startswith(F.ltrim(skills), F.lit("{"))).select(
        F.explode(F.from_json(skills, "map<string,string>")).alias("pos", "skill")
    )
    return listed.select(F.col("pos").cast("bigint"), "skill").unionByName(
        keyed.select(F.col("pos").cast("bigint"), "skill")
    )


def clean_skills(skills: DataFrame) -> DataFrame:
    """Lowercased distinct skills at their first position."""
    lowered = skills.select("pos", F.lower("skill").alias("skill"))
    return distinct_at_first_position(lowered, "skill", "pos")
