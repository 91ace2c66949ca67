"""Tables written between the steps of a job.

A step that is read many times (an iteration's state, a lookup table whose size must be known) is
written once to the cluster's shared folder and read back, so a lost executor costs a re-read and
not a re-run, and Catalyst knows the table's real size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`; set only for a local session that names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="longspan-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/longspan/{application}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write the table to a fresh path and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    save_table(df, path, partition_by)
    return spark.read.schema(df.schema).parquet(path)


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_clustered(df: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """Write the table in ranges of `columns`, sorted within each file, so that a filter on them
    reads few files and few row groups. `files` defaults to the session's shuffle partitions."""
    dealt = df.repartitionByRange(*([files] if files else []), *columns)
    save_table(dealt.sortWithinPartitions(*columns), path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
