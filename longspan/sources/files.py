"""Readers and writers for text files that hold events, counts and dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

EVENT_SCHEMA = "patient_num bigint, start_date date, feature_id string"
MONTHLY_SCHEMA = "patient_num bigint, feature_id string, month int, n bigint"
CODE_SCHEMA = "feature_id string, generic_name string, treatment_class string"
PAIR_SCHEMA = "i int, j int, count double"


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | StructType,
    sep: str = ",",
    name_pattern: str | None = None,
) -> DataFrame:
    """Text files with a header under an explicit schema, optionally only names that match."""
    reader = spark.read.option("header", True).option("sep", sep).schema(schema)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern).option("recursiveFileLookup", True)
    return reader.csv(paths if isinstance(paths, str) else list(paths))


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths of a generated list that are there; a missing batch is skipped, not an error."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    listed: dict[str, set[str]] = {}
    found = []
    for path in paths:
        parent, _, name = path.rstrip("/").rpartition("/")
        if parent not in listed:  # one listing for each folder
            folder = jvm.org.apache.hadoop.fs.Path(parent)
            files = folder.getFileSystem(conf)
            inside = files.listStatus(folder) if files.exists(folder) else []
            listed[parent] = {s.getPath().getName() for s in inside}
        if name in listed[parent]:
            found.append(path)
    return found


def batch_names(pattern: str, first: int, last: int, width: int) -> list[str]:
    """File names of consecutive id batches, such as `batch_{}-{}` for 1-1000, 1001-2000, ..."""
    return [pattern.format(k, k + width - 1) for k in range(first, last + 1, width)]


def read_batches(
    spark: SparkSession, paths: Sequence[str], schema: str | StructType, keep=None
) -> DataFrame:
    """One scan over all batches that exist; the row filter is pushed into the scan."""
    found = existing_paths(spark, paths)
    if not found:
        return spark.createDataFrame([], schema)
    df = read_csv(spark, found, schema)
    return df if keep is None else df.where(keep)


def with_file_year(df: DataFrame, column: str = "year") -> DataFrame:
    """Year taken from the last four digits in the name of the file a row came from."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4})[^\d/]*(?:/[^/]*)?$", 1)
    return df.withColumn(column, name.cast("int"))


def read_yearly_pairs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Pair counts kept as one file per year, as (period, i, j, n); missing years are skipped."""
    found = existing_paths(spark, paths)
    if not found:
        return spark.createDataFrame([], "period int, i int, j int, n double")
    rows = with_file_year(read_csv(spark, found, PAIR_SCHEMA), "period")
    return rows.select("period", "i", "j", F.col("count").alias("n"))


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.option("header", True).mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
