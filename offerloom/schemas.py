"""Column layout of every table the engine reads or writes."""

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def _fields(spec: str) -> T.StructType:
    """Schema from ``name TYPE`` pairs; unlike a DDL text it needs no session."""
    pairs = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_RAW = (
    "vacancy_name STRING, company STRING, location STRING, work_modality_english STRING, "
    "seniority STRING, link STRING, job_function STRING, industries STRING, "
    "description STRING, apply_link STRING, publication_date STRING, "
    "query_keyword STRING, country STRING, scraping_date STRING"
)

# Dates stay text in the landing format and are parsed once, in the offers plan.
RAW_OFFERS = _fields(_RAW)
OFFERS = _fields(
    _RAW.replace("publication_date STRING", "publication_date DATE").replace(
        "scraping_date STRING", "scraping_date DATE"
    )
    + ", job_id STRING, remote BOOLEAN, skills ARRAY<STRING>, available BOOLEAN"
)
SEEKERS = _fields(
    "user_id STRING, seniority ARRAY<STRING>, location ARRAY<STRING>, "
    "work_modality_english ARRAY<STRING>, remote ARRAY<STRING>, english STRING, "
    "role_weight STRING, similarity_threshold STRING, skills ARRAY<STRING>, "
    "job_titles ARRAY<STRING>"
)
SKILLS = _fields("pos BIGINT, skill STRING")
KEYWORDS = _fields("role STRING, country STRING")
PAGES = _fields("url STRING, status_code INT, body STRING, fetched_at TIMESTAMP_NTZ")
WORDS = _fields("word STRING")
CHECKS = _fields("job_id STRING, available BOOLEAN")
SEEKER_EMBEDS = _fields(
    "user_id STRING, avg_skill_embeds ARRAY<FLOAT>, avg_role_embeds ARRAY<FLOAT>"
)
OFFER_EMBEDS = _fields("job_id STRING, avg_skill_embeds ARRAY<FLOAT>, role_embeds ARRAY<FLOAT>")
MATCHES = _fields(
    "user_id STRING, job_id STRING, match_id STRING, match_date DATE, score DOUBLE"
)
