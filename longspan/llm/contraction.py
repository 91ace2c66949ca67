"""Sums over the subtree of every node, by parallel tree contraction.

Rounds alternate two steps until only the root is left. Rake: a leaf's sum is final; it goes to its
parent and the leaf leaves the tree. Compress: a chain of nodes with one child each is cut out in
join rounds of pointer jumping, and what the chain adds is kept on the edge that takes its place. A
round at least halves the leaves, so rounds are logarithmic in them whatever the depth, and jumps are
logarithmic in the longest chain. Then the cut chains are put back in reverse: a chain node's sum is
what the chain holds from it on, plus the sum of the node below the chain.

Every step is a join on keys that are unique on both sides, or a sum combined before its shuffle;
only the last join meets one key often (the end of a long chain), and its hot keys are split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from longspan.operators.joins import salted_join
from longspan.sources.stages import stage


def subtree_sums(nodes: DataFrame, sums: Sequence[str]) -> DataFrame:
    """node and, under the same names, the sums over each node's subtree, itself included.

    `nodes` has one row for each `node`, its `parent` (null for a root) and bigint columns `sums`;
    keys may be structs. Every parent is a node and there is no cycle.
    """
    sums = list(sums)
    ups = {s: f"_up_{s}" for s in sums}
    alive = stage(
        nodes.select("node", "parent", *[F.col(s).cast("bigint").alias(s) for s in sums], *[F.lit(0).cast("bigint").alias(u) for u in ups.values()]),
        "alive",
    )
    done, cut = [], []
    while not alive.isEmpty():
        leaves, inner = raked(alive, ups)
        done.append(leaves)
        chain, ends = chains(inner, ups)
        if chain is None:
            alive = inner
            continue
        cut.append(ends)
        alive = stage(without_chains(inner, chain, ends, ups), "alive")
    if not done:
        return alive.select("node", *sums)
    total = stage(reduce(DataFrame.unionByName, done), "sums")
    for ends in reversed(cut):
        below = total.select(F.col("node").alias("_next"), *[F.col(s).alias(f"_below_{s}") for s in sums])
        back = salted_join(ends, below, ["_next"]).select("node", *[(F.col(s) + F.col(f"_below_{s}")).alias(s) for s in sums])
        total = stage(total.unionByName(back), "sums")
    return total


def raked(alive: DataFrame, ups: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The leaves with their final sums, and the other nodes with their leaves' sums added."""
    parents = alive.groupBy(F.col("parent").alias("node")).agg(F.lit(True).alias("_inner"))
    marked = stage(alive.join(parents, "node", "left"), "marked")
    leaves = marked.where(F.col("_inner").isNull())
    passed = leaves.groupBy(F.col("parent").alias("node")).agg(*[F.sum(F.col(s) + F.col(u)).alias(f"_from_{s}") for s, u in ups.items()])
    inner = marked.where(F.col("_inner")).drop("_inner").join(passed, "node", "left")
    added = {s: F.col(s) + F.coalesce(f"_from_{s}", F.lit(0)) for s in ups}
    return leaves.select("node", *ups), stage(inner.withColumns(added).select(*alive.columns), "inner")


def chains(inner: DataFrame, ups: dict[str, str]) -> tuple[DataFrame | None, DataFrame | None]:
    """The nodes below a root with one child each, and for each of them the first node below that
    is no such node (`_next`) with what lies from it down to there."""
    only = (
        inner.where(F.col("parent").isNotNull())
        .groupBy(F.col("parent").alias("node"))
        .agg(F.count("*").alias("_n"), F.min("node").alias("_next"), *[F.sum(u).alias(f"_edge_{s}") for s, u in ups.items()])
        .where("_n = 1")
    )
    held = {s: F.col(s) + F.col(f"_edge_{s}") for s in ups}
    chain = inner.where(F.col("parent").isNotNull()).join(only, "node").withColumns(held)
    chain = stage(chain.select("node", "parent", "_next", *ups, *ups.values()), "chain")
    if chain.isEmpty():
        return None, None
    ends = chain.select("node", "_next", *ups)
    while True:
        ahead = ends.select(F.col("node").alias("_next"), F.col("_next").alias("_far"), *[F.col(s).alias(f"_more_{s}") for s in ups])
        jumped = ends.join(ahead, "_next", "left").select(
            "node", F.coalesce("_far", "_next").alias("_next"),
            *[(F.col(s) + F.coalesce(f"_more_{s}", F.lit(0))).alias(s) for s in ups],
            F.col("_far").isNotNull().alias("_moved"),
        )
        ends = stage(jumped, "jumped")
        moved = not ends.where("_moved").isEmpty()
        ends = ends.drop("_moved")
        if not moved:
            return chain, ends


def without_chains(inner: DataFrame, chain: DataFrame, ends: DataFrame, ups: dict[str, str]) -> DataFrame:
    """The other nodes; one below a chain hangs on the node above it and passes on what the chain holds."""
    first = chain.join(chain.select(F.col("_next").alias("node")), "node", "left_anti").select("node", F.col("parent").alias("_above"), *ups.values())
    tops = first.join(ends, "node").select(
        F.col("_next").alias("node"), "_above", *[(F.col(s) + F.col(u)).alias(f"_held_{s}") for s, u in ups.items()]
    )
    rest = inner.join(chain.select("node"), "node", "left_anti").join(tops, "node", "left")
    hung = {u: F.coalesce(f"_held_{s}", u) for s, u in ups.items()}
    return rest.withColumns({"parent": F.coalesce("_above", "parent"), **hung}).select(*inner.columns)
