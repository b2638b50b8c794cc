"""Folder listings through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def file_context(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's file context and path object of ``path``."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    where = fs.Path(path)
    return fs.FileContext.getFileContext(where.getFileSystem(conf).getUri(), conf), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly below ``path``; none where nothing is."""
    context, where = file_context(spark, path)
    if not context.util().exists(where):
        return []
    return [s.getPath().getName() for s in context.util().listStatus(where)]
