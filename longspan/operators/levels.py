"""Ordered category levels: sorted unique values with codes that keep their order through joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from longspan.operators.joins import salted_join
from longspan.operators.ranking import running_sums


def ordered_levels(df: DataFrame, column: str, keys: Sequence[str] = (), first: Column | None = None) -> DataFrame:
    """keys, `column` and `level`: the distinct values in order, numbered from 1 within the keys.

    Values for which `first` holds come before all others. Null is no level. Values are dealt into
    ranges of their order, so any number of levels is numbered without one sorting task.
    """
    keys = list(keys)
    head = F.lit(False) if first is None else F.coalesce(first, F.lit(False))
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.min((~head).cast("int")).alias("_later"))
    placed = running_sums(values.withColumn("_n", F.lit(1)), keys, ["_later", column], ["_n"])
    return placed.select(*keys, column, (F.col("_n_before") + 1).cast("int").alias("level"))


def with_level(df: DataFrame, levels: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add each row's `level`; null for values that are no level. A frequent value is split."""
    return salted_join(df, levels, [*keys, column], "left")
