"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order, null last, take the weights in turn and share `share` times all words
by them; a target stops at `most` times its source, and the excess is shared again by weight among
the rest. A source repeats all its documents as often as its target holds it whole. The rest of the
target is filled with documents chosen by length: documents are counted by exact length, each
length gives an even share first, and a bounded-knapsack table of sums closes what remains. Of each
length the documents with the smallest seeded hashes are taken. Lengths are planned one source at a
time, from one row for each distinct length; documents are never brought together by source.

Defined cases: a null text has 0 words and takes 0; null is a source of its own. Rows of one doc_id
and text stand for each other: as many of them as the plan needs are picked, whichever they are.
Other columns are ignored. An empty table gives an empty result, and if no row has a word every
target is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longspan.sources.stages import stage

BUCKET_BITS = 12
#: Words that the table of sums may close for a source.
TABLE = 1 << 16


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Target of each source: by weight, at most `most` times its size, excess shared again."""
    goal, capped = [0.0] * len(sizes), [s == 0 for s in sizes]
    total = share * sum(sizes)
    while True:
        free = total - sum(most * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        for k, s in enumerate(sizes):
            goal[k] = most * s if capped[k] else free * weights[k] / weight
        over = [k for k, s in enumerate(sizes) if not capped[k] and goal[k] > most * s]
        if not over:
            return goal
        for k in over:
            capped[k] = True


def closest_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length give the largest sum within the budget: bounded knapsack."""
    used = np.zeros(len(lengths), np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int32)
    steps: list[tuple[int, int]] = []
    for k in np.flatnonzero((lengths > 0) & (lengths <= budget) & (counts > 0)):
        left, part = min(int(counts[k]), budget // int(lengths[k])), 1
        while left and not reached[budget]:
            part = min(part, left)
            weight = int(lengths[k]) * part
            new = np.flatnonzero(reached[:-weight] & ~reached[weight:]) + weight
            reached[new] = True
            by[new] = len(steps)
            steps.append((int(k), part))
            left, part = left - part, 2 * part
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, part = steps[by[at]]
        used[k] += part
        at -= int(lengths[k]) * part
    return used


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many documents of each length to take, for a sum close to and within the budget."""
    total = int((lengths * counts).sum())
    if total == 0 or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    taken = np.array([int(c) * budget // total if l else 0 for l, c in zip(lengths, counts)], np.int64)
    rest = budget - int((lengths * taken).sum())
    # Each length lacks less than one document of its share; one more of some brings the rest near.
    for k in np.argsort(-lengths):
        if taken[k] < counts[k] and 0 < lengths[k] <= rest - table // 2:
            taken[k] += 1
            rest -= int(lengths[k])
    return taken + closest_sum(lengths, counts - taken, rest)


def mix_plan(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with `_size`, `_hash`, and a plan by source and size: `_repeats`, `_last` and `_some`."""
    spark = docs.sparkSession
    rows = stage(_sized(docs, seed).select("doc_id", "source", "_size", "_hash"), "sized")
    counts = stage(rows.groupBy("source", "_size").agg(F.count("*").alias("_n")), "lengths")
    # One row for each source.
    sums = {r.source: r.s for r in counts.groupBy("source").agg(F.sum(F.col("_size") * F.col("_n")).alias("s")).collect()}
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    goals = targets([sums[s] for s in names], [weights[k % len(weights)] for k in range(len(names))], share, most)
    table = [(s, sums[s], float(g)) for s, g in zip(names, goals)]
    sources = spark.createDataFrame(table, "source string, source_size bigint, target double")

    def plan(lot: pd.DataFrame) -> pd.DataFrame:
        size, goal = int(lot["source_size"].iloc[0]), float(lot["target"].iloc[0])
        repeats = int(goal // size) if size else 0
        lot = lot.sort_values("_size", ignore_index=True)
        extra = fit_budget(lot["_size"].to_numpy(np.int64), lot["_n"].to_numpy(np.int64), round(goal - repeats * size))
        return lot.assign(_repeats=np.int64(repeats), _extra=extra)[["source", "source_size", "target", "_size", "_repeats", "_extra"]]

    same = F.col("source").eqNullSafe(F.col("_source"))
    planned = counts.join(F.broadcast(sources.withColumnRenamed("source", "_source")), same).drop("_source")
    kinds = "source string, source_size bigint, target double, _size bigint, _repeats bigint, _extra bigint"
    plans = stage(planned.groupBy("source").applyInPandas(plan, kinds), "plan")
    return rows, _last_picked(rows, plans)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns(
        {
            "_size": words_in(F.col("text")),
            "_hash": F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed)),
        }
    )


def _joined(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on source (null equals null), _size and more; the left side's columns name the keys."""
    keys = ["source", "_size", *more]
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _last_picked(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plan with `_last`, the largest hash to pick of a source and size (null: none), and
    `_some`, how many of the rows with that hash are needed (null: all).

    Hashes are counted in 4,096 buckets first, so only the bucket in which the count runs out is
    put in order; rows with one hash are counted before that and are one row there.
    """
    wanted = plans.where("_extra > 0").select("source", "_size", "_extra")
    bucket = F.shiftright("_hash", 64 - BUCKET_BITS).cast("int")
    held = rows.withColumn("_bucket", bucket)
    counts = held.groupBy("source", "_size", "_bucket").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("source", "_size").orderBy("_bucket"))
    counts = counts.withColumn("_upto", upto)
    edges = (
        _joined(counts, wanted)
        .where("_upto >= _extra and _upto - _n < _extra")
        .selectExpr("source", "_size", "_bucket", "_extra - _upto + _n as _need")
    )
    edge = _joined(held, edges, "_bucket").groupBy("source", "_size", "_hash", "_need").agg(F.count("*").alias("_n"))
    place = F.sum("_n").over(W.partitionBy("source", "_size").orderBy("_hash"))
    last = (
        edge.withColumn("_upto", place)
        .where("_upto >= _need and _upto - _n < _need")
        .selectExpr("source", "_size", "_hash as _last", "if(_upto > _need, _need - _upto + _n, null) as _some")
    )
    return stage(_joined(plans, last, how="left").drop("_extra"), "picked")


def _copies(rows: DataFrame, plans: DataFrame) -> DataFrame:
    found = _joined(rows, plans)
    tied = F.coalesce((F.col("_hash") == F.col("_last")) & F.col("_some").isNotNull(), F.lit(False))
    more = F.when(F.col("_hash") <= F.col("_last"), 1).otherwise(0)
    if not plans.where("_some is not null").isEmpty():
        few = _first_of_tied(found.where(tied))
        found = found.where(~tied).withColumn("_more", more).unionByName(few)
    else:
        found = found.withColumn("_more", more)
    copies = F.col("_repeats") + F.col("_more")
    return found.withColumn("_copies", F.when(F.col("_size") > 0, copies).otherwise(F.least(copies, F.lit(1)))).drop("_more")


def _first_of_tied(tied: DataFrame) -> DataFrame:
    """Tied rows with `_more`: 1 for `_some` of them in each source and size, else 0.

    Rows are numbered as they are written, so a task that runs again reads the same numbers, and
    dealt into buckets by that number: a row's place is counted within its bucket only.
    """
    tied = stage(tied.withColumn("_row", F.monotonically_increasing_id()), "tied")
    tied = tied.withColumn("_bucket", F.shiftright(F.xxhash64("_row"), 64 - BUCKET_BITS).cast("int"))
    held = tied.groupBy("source", "_size", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("source", "_size").orderBy("_bucket")) - F.col("_n")
    found = _joined(tied, held.select("source", "_size", "_bucket", before.alias("_before")), "_bucket")
    place = F.row_number().over(W.partitionBy("source", "_size", "_bucket").orderBy("_row"))
    picked = F.when(F.col("_before") + place <= F.col("_some"), 1).otherwise(0)
    return found.withColumn("_more", picked).drop("_row", "_bucket", "_before")


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 8
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) and copies for each row."""
    rows, plans = mix_plan(docs.select("doc_id", "text", "source"), weights, share, most, seed)
    found = _copies(rows, plans)
    return found.select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"),
    )


def mixed(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 8
) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns."""
    _, plans = mix_plan(docs.select("doc_id", "text", "source"), weights, share, most, seed)
    packed = _sized(docs.select("doc_id", "text", "source", F.struct("*").alias("row")), seed)
    found = _copies(packed.select("row", "source", "_size", "_hash"), plans).where("_copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), "_copies"))).select("row.*")
