"""Means and variances from batches: states that are stored by batch and merged pair by pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

STATE = "struct<n:bigint,mean:double,m2:double>"


def moment_states(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and `state`: number, mean and sum of squared deviations of the values that are not null."""
    known = rows.where(F.col(value).isNotNull())
    n = F.count(value)
    state = F.struct(n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2"))
    return known.groupBy(*keys).agg(state.cast(STATE).alias("state"))


def merge_pair(a: Column, b: Column) -> Column:
    """The state of two batches together; deviations are about the common mean, so nothing cancels."""
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"),
        (a["mean"] + gap * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"),
    ).cast(STATE)
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def merged_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state a key from any number of batches. A key has one row a batch, so a list of them is
    bounded by the number of batches; it is sorted, so results repeat."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")).cast(STATE)
    listed = states.groupBy(*keys).agg(F.sort_array(F.collect_list("state")).alias("_states"))
    return listed.select(*keys, F.aggregate("_states", empty, merge_pair).alias("state"))


def sample_variance(state: str = "state") -> Column:
    """Variance over n - 1; null for fewer than two values."""
    return F.when(F.col(f"{state}.n") > 1, F.col(f"{state}.m2") / (F.col(f"{state}.n") - 1))
