"""Session builder and the shared folder for checkpoints and staged tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Applied only by build_session; a session handed in by the cluster keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages and descriptions vary from bytes to megabytes: bound a batch by size too.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Call sites recorded for every column make large expressions slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    app: str = "offerloom",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Local sessions fall back to a new temporary folder. A cluster session must
    name one, because a driver-local path would not survive an executor loss.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="offerloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df):
    """Materialise ``df`` in the shared folder, so a lost executor costs a re-read."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
