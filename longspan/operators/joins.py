"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from longspan.sources.stages import stage


def shuffle_width(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    """Keys with at least 1/width of the rows, and the number of parts to split each into.

    At most `width` keys can have that many, which bounds the result whatever the size of the
    input. The count is combined on the map side, so a hot key is a few rows by the time it is
    shuffled. A part is about a quarter of an even shuffle partition.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    return counts.where(F.col("_rows") * F.lit(width) >= total).select(
        *on, F.ceil(F.col("_rows") * F.lit(4 * width) / total).cast("int").alias("_parts")
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    width: int | None = None,
) -> DataFrame:
    """Equi-join whose hot keys are spread over tasks in proportion to their rows.

    `how` keeps or drops rows of `big` (inner, left, left_semi, left_anti). Key shares are measured
    first, over the key columns only; without a hot key this is a plain join. A hot key's rows are
    split by a hash of the whole row, which a re-run task repeats exactly; the other side's rows
    for that key are copied to every part. All other keys take an ordinary shuffle join.
    """
    on = list(on)
    width = width or shuffle_width(big)
    hot = stage(hot_keys(big, on, width), "hot")
    if hot.isEmpty():
        return big.join(small, on, how)
    hot = F.broadcast(hot)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    row = F.xxhash64(*[F.col(c) for c in big.columns])
    # Rows with a null key match nothing, so they may lie anywhere.
    nowhere = reduce(or_, [F.col(c).isNull() for c in on])
    spread = F.when(nowhere, F.lit(4 * width)).otherwise(parts).cast("bigint")
    left = (
        big.join(hot, on, "left")
        .withColumn("_part", F.pmod(row, spread).cast("int"))
        .drop("_parts")
    )
    right = (
        small.join(hot, on, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return left.join(right, [*on, "_part"], how).drop("_part")


def first_per_key(df: DataFrame, on: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key, the least by `order` then by all other columns.

    A minimum over a struct combines on the map side; a hot key never gathers in one task.
    """
    on = list(on)
    rest = [c for c in df.columns if c not in on]
    if not rest:
        return df.distinct()
    ranked = [*order, *[c for c in rest if c not in order]]
    nulls_last = []
    for name in ranked:
        nulls_last += [F.col(name).isNull().alias(f"_null_{name}"), F.col(name)]
    return (
        df.groupBy(*on)
        .agg(F.min(F.struct(*nulls_last)).alias("_first"))
        .select(*on, *[F.col(f"_first.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def lookup_join(
    big: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_bytes: int = 16 << 20,
) -> DataFrame:
    """First-match lookup in a dimension: never multiplies rows.

    The dimension is written once and its values are measured. It is broadcast only when they take
    at most `max_bytes`; beyond that the join shuffles and splits hot keys. Both ways give the same
    rows.
    """
    single = stage(first_per_key(dimension, on), "lookup")
    lengths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(8) for c in single.columns]
    if (single.agg(F.sum(sum(lengths, F.lit(0)))).first()[0] or 0) <= max_bytes:
        return big.join(F.broadcast(single), list(on), how)
    return salted_join(big, single, on, how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a null key matches a null key; keys come from the left side."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition: Column = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])
