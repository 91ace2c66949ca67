"""Descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from longspan.operators.ranking import quantiles


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Counts per value; nulls are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def long_values(df: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
    """(variable, value) rows, one per input row and named column."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast(kind).alias("value")) for c in names]
    return df.select(F.inline(F.array(*pairs)))


def numeric_summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, median, mean, maximum and number missing per variable."""
    values = long_values(df, names, "double")
    moments = values.groupBy("variable").agg(
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    marks = quantiles(values, ["variable"], "value", [0.25, 0.5, 0.75])
    return (
        moments.join(marks, "variable", "left")
        .select(
            "variable",
            "min",
            F.col("quantiles")[0].alias("q1"),
            F.col("quantiles")[1].alias("median"),
            "mean",
            F.col("quantiles")[2].alias("q3"),
            "max",
            "n_missing",
        )
    )


def table_one(
    df: DataFrame, variables: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Mean and SD of continuous variables, n and percent per level of categorical ones.

    Listed variables that the table lacks are left out. Percentages are over non-null values.
    Columns: variable, level, n, missing, mean, sd, percent.
    """
    present = [v for v in variables if v in df.columns]
    factors = [v for v in present if v in set(categorical)]
    numbers = [v for v in present if v not in set(categorical)]
    parts = []
    if numbers:
        parts.append(
            long_values(df, numbers, "double")
            .groupBy("variable")
            .agg(
                F.lit(None).cast("string").alias("level"),
                F.count("value").alias("n"),
                F.count_if(F.col("value").isNull()).alias("missing"),
                F.avg("value").alias("mean"),
                F.stddev_samp("value").alias("sd"),
                F.lit(None).cast("double").alias("percent"),
            )
        )
    if factors:
        levels = long_values(df, factors, "string").groupBy("variable", "value").agg(
            F.count("*").alias("n")
        )
        # Per-variable totals come from the level counts, not from a second pass over the rows.
        totals = levels.groupBy("variable").agg(
            F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("_known"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        )
        null = F.lit(None).cast("double")
        parts.append(
            levels.where(F.col("value").isNotNull())
            .join(F.broadcast(totals), "variable")
            .select(
                "variable",
                F.col("value").alias("level"),
                "n",
                "missing",
                null.alias("mean"),
                null.alias("sd"),
                (F.col("n") * 100.0 / F.col("_known")).alias("percent"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def log_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of log counts."""
    return df.agg(F.corr(F.log1p(a), F.log1p(b)).alias("correlation"))
