"""The dealt operators bound to the driver's tables, next to their checks in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerloom.bindings import Bound
from offerloom.llm import common, content_sort, exact_topk, lookup_clusters, mixing, nearest


def op1_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return exact_topk.self_search(common.embeddings(spark, folder))


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.self_nearest(common.embeddings(spark, folder))


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(common.documents(spark, folder))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from offerloom.llm.line_dedup import without_repeated_lines

    docs = common.documents(spark, folder).select("doc_id", "text")
    return without_repeated_lines(docs)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from offerloom.llm.language_id import language_answers

    return language_answers(common.documents(spark, folder))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from offerloom.llm.quality import quality_scores

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality_scores(common.documents(spark, folder), labels)


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from offerloom.llm.pii import personal_data

    return personal_data(common.documents(spark, folder))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from offerloom.llm.jaccard_join import jaccard_components

    return jaccard_components(common.documents(spark, folder), k=4, num=85, den=100)


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from offerloom.llm.packing import pack_documents

    path = common.tokenizer_path("word_bpe_49k.json")
    return pack_documents(common.documents(spark, folder), path, keeps_spaces=False)


def op9_token_records(spark: SparkSession, folder: str) -> DataFrame:
    from offerloom.llm.records import token_file_digest

    path = common.tokenizer_path("byte_bpe_50k.json")
    return token_file_digest(spark, common.documents(spark, folder), path, keeps_spaces=True)


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return lookup_clusters.cluster_vectors(common.embeddings(spark, folder), dim=64, scale=64, k=16, rounds=3)


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.copy_groups(common.documents(spark, folder))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from offerloom.llm.periodic_runs import run_digests

    return run_digests(common.documents(spark, folder))


QUERIES: dict[str, Bound] = {
    "op1_exact_topk": Bound(op1_exact_topk, exact_topk.ORACLE_SQL),
    "op2_source_mixing": Bound(op2_source_mixing, mixing.ORACLE_SQL),
    "op3_line_dedup": Bound(op3_line_dedup),
    "op4_language_id": Bound(op4_language_id),
    "op5_quality_classifier": Bound(op5_quality_classifier),
    "op6_jaccard_join": Bound(op6_jaccard_join),
    "op7_best_fit_packing": Bound(op7_best_fit_packing),
    "op10_personal_data": Bound(op10_personal_data),
    "op8_nearest_neighbours": Bound(op8_nearest_neighbours, nearest.ORACLE_SQL),
    "op9_token_records": Bound(op9_token_records),
    "op11_centroid_clustering": Bound(op11_centroid_clustering, lookup_clusters.ORACLE_SQL),
    "op12_exact_dedup": Bound(op12_exact_dedup, content_sort.ORACLE_SQL),
    "op13_periodic_runs": Bound(op13_periodic_runs),
}
