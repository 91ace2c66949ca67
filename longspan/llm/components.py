"""Connected components of a graph given as edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from longspan.sources.stages import stage


def join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the trees of a and b within a task; every tree hangs flat on its smallest place."""
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        differ = low != high
        a, b = a[differ], b[differ]
        np.minimum.at(parent, high[differ], low[differ])
        while not np.array_equal(further := parent[parent], parent):
            parent = further
    return parent


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the bigint columns a, b.

    Rounds of large and small stars: every node hands its neighbours the smallest node it sees. A
    round writes its edges to the shared folder, and the rounds end when the edges stay the same.
    A node with very many neighbours has its minimum combined before the shuffle, and the join that
    hands it out can be split by Spark.
    """
    edges = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
        state = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        edges = stage(small.distinct(), "edges")
