"""Hard negatives by coordinate pruning over length buckets.

Vectors become integers, floor(256 x), and a score is the exact inner product. Rows of one label are
ordered by length and cut into lots: buckets of about equal length. A task holds one lot with a
sorted list of the unit vectors' values for every coordinate. An anchor comes with a score that a
row must reach; over the longest length in the lot this is a least cosine c. For unit vectors at an
angle of at most t = arccos c no coordinate's angle differs by more than t, so each of the anchor's
`focus` largest coordinates leaves a range of feasible values: the shortest of these ranges is cut
from its list, the others cut the candidates down, and what is left is scored exactly.

Positives come in two passes: an anchor's own lot gives a score that its fifth positive reaches,
and only lots that can hold better rows are asked again. Negatives must reach 0.8 times the least
positive. A lot that cannot reach the score is never sent the anchor. Of each lot only the leading
rows of an anchor leave the task, so no group is collected.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component take no
part. Vectors of different lengths are not compared. Equal rows are as many rows: an anchor with n
equal rows gives n times its result, and the others are its positives like any other rows. A
positive below zero has no feasible negative. Components stop at 64 bits, and so do scores. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longspan.llm.batches import slices
from longspan.operators.joins import salted_join
from longspan.operators.ranking import running_sums
from longspan.sources.stages import stage

#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53
LONGEST = 2**63 - 1
LOT = ["label", "dims", "lot"]


def points(rows: DataFrame) -> DataFrame:
    """Rows that take part: integer vectors, moved labels, equal rows once with their number `n`."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    label, vec_id = F.col("label").cast("bigint"), F.col("vec_id").cast("bigint")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    vector = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256))
    usable = rows.where(whole & F.coalesce(fine, F.lit(False)))
    return usable.select(vec_id.alias("vec_id"), moved.alias("label"), vector.alias("vector")).groupBy("vec_id", "label", "vector").agg(F.count("*").alias("n"))


def in_lots(rows: DataFrame, lot_values: int) -> DataFrame:
    """Add dims, length and lot: runs of rows of one label and number of dimensions, longest first,
    of `lot_values` components or 64 rows."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    sized = rows.withColumns({"dims": F.size("vector"), "length": length}).withColumns(
        {"shortness": -F.col("length"), "_one": F.lit(1), "_tie": F.xxhash64("vector")}
    )
    placed = running_sums(sized, ["label", "dims"], ["shortness", "vec_id", "_tie"], ["_one"])
    per_lot = F.greatest(F.lit(64), F.floor(F.lit(lot_values) / F.greatest("dims", F.lit(1))))
    return placed.withColumn("lot", F.floor(F.col("_one_before") / per_lot)).select("vec_id", "label", "dims", "vector", "n", "length", "lot")


class Lot:
    """The rows of one length bucket and their sorted coordinate lists."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("vec_id").to_numpy()
        self.n = rows.column("n").to_numpy()
        self.x = matrix(rows.column("vector").combine_chunks())
        lengths = np.linalg.norm(self.x.astype(np.float64), axis=1)
        self.longest = lengths.max()
        self.unit = self.x / np.maximum(lengths, 1.0)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, axis=0)
        self.largest = float(np.abs(self.x).max(initial=0))

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return (self.x[at].astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
        own = [int(v) for v in anchor]
        exact = (sum(int(a) * b for a, b in zip(row, own)) for row in self.x[at])
        return np.array([max(-LONGEST, min(LONGEST, s)) for s in exact], np.int64)

    def strongest(self, anchor: np.ndarray, focus: int) -> np.ndarray:
        return np.argsort(-np.abs(anchor), kind="stable")[:focus]

    def candidates(self, anchor: np.ndarray, least: float, focus: int) -> np.ndarray:
        """Rows whose focus coordinates can belong to a score of `least` or more."""
        length = float(np.linalg.norm(anchor.astype(np.float64)))
        everyone = np.arange(len(self.ids))
        if least <= 0 or not len(anchor):
            return everyone
        reach = length * self.longest
        if reach * (1 + 1e-9) < least:
            return everyone[:0]
        apart = np.arccos(min(1.0, least / reach))
        picks = self.strongest(anchor, focus)
        angle = np.arccos(np.clip(anchor[picks] / length, -1, 1))
        low, high = np.cos(np.minimum(np.pi, angle + apart)) - 1e-9, np.cos(np.maximum(0, angle - apart)) + 1e-9
        first = np.array([np.searchsorted(self.lists[:, f], v, "left") for f, v in zip(picks, low)])
        last = np.array([np.searchsorted(self.lists[:, f], v, "right") for f, v in zip(picks, high)])
        short = int(np.argmin(last - first))
        found = self.order[first[short] : last[short], picks[short]]
        for k, f in enumerate(picks):
            if k != short:
                values = self.unit[found, f]
                found = found[(values >= low[k]) & (values <= high[k])]
        return found

    def others(self, vec_id: int, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows behind each place, without the anchor's own one."""
        own = (self.ids[at] == vec_id) & (self.x[at] == anchor).all(axis=1)
        return self.n[at] - own

    def leading(self, vec_id: int, anchor: np.ndarray, least: float | None, k: int, focus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, scores and numbers of rows of the first k other rows, by score and vec_id."""
        if len(anchor):
            # The rows that one list puts first already reach some score.
            f = self.strongest(anchor, 1)[0]
            some = self.order[-4 * k :, f] if anchor[f] >= 0 else self.order[: 4 * k, f]
            n, scores = self.others(vec_id, anchor, some), self.scores(anchor, some)
            ranked = np.sort(np.repeat(scores, np.minimum(n, k)))[::-1]
            if len(ranked) >= k:
                least = max(float(ranked[k - 1]), -np.inf if least is None else least)
        at = self.candidates(anchor, -1.0 if least is None else least, focus)
        n = self.others(vec_id, anchor, at)
        return first_rows(at[n > 0], self.scores(anchor, at[n > 0]), n[n > 0], self.ids, k)

    def windowed(self, anchor: np.ndarray, positives: list[int], k: int, focus: int) -> Iterator[tuple[int, tuple]]:
        """For each positive score the first k rows between 0.8 times it and itself."""
        at = self.candidates(anchor, 0.8 * min(positives) * (1 - 1e-12), focus)
        scores = self.scores(anchor, at)
        for positive in positives:
            # As whole numbers: 80 p <= 100 s is s >= ceil(4 p / 5).
            inside = (scores >= -(-4 * positive // 5)) & (scores <= positive)
            if inside.any():
                yield positive, first_rows(at[inside], scores[inside], self.n[at[inside]], self.ids, k)


def first_rows(at, scores, n, ids, k):
    order = np.lexsort((ids[at], -scores))[:k]
    return at[order], scores[order], n[order]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def searched(rows: DataFrame, asked: DataFrame, k: int, focus: int) -> DataFrame:
    """Send anchors to the lots they ask; (anchor, positive, vec_id, score, n) of what leads there.

    `asked` has the lot, the anchor's key, vec_id and vector, and either `least`, a score to reach
    (or null), or `positives`, the scores whose windows are asked.
    """
    empty = F.array().cast("array<bigint>")
    held = rows.select(*LOT, F.lit(0).alias("role"), F.lit(0).cast("bigint").alias("anchor"), "vec_id", "vector", "n", F.lit(None).cast("double").alias("least"), empty.alias("positives"))
    sent = asked.select(*LOT, F.lit(1).alias("role"), "anchor", "vec_id", "vector", F.lit(0).cast("bigint").alias("n"), "least", "positives")
    both = held.unionByName(sent).repartition(*LOT).sortWithinPartitions(*LOT, "role")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, lot = None, [], None
        for batch in slices(batches, 1024):
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in [*LOT, "role"]])
            turns = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1
            for a, b in zip([0, *turns], [*turns, batch.num_rows]):
                run, here = batch.slice(a, b - a), tuple(keys[:3, a])
                if here != place:
                    place, parts, lot = here, [], None
                if keys[3, a] == 0:
                    parts.append(run)
                    continue
                if lot is None:
                    lot = Lot(pa.Table.from_batches(parts))
                    parts = []
                out = {c: [] for c in ("anchor", "positive", "vec_id", "score", "n")}
                vectors = matrix(run.column("vector"))
                for row, vector in zip(run.select(["anchor", "vec_id", "least", "positives"]).to_pylist(), vectors):
                    if row["positives"]:
                        lots = lot.windowed(vector, row["positives"], k, focus)
                    else:
                        lots = [(0, lot.leading(row["vec_id"], vector, row["least"], k, focus))]
                    for positive, (at, scores, n) in lots:
                        out["anchor"] += [row["anchor"]] * len(at)
                        out["positive"] += [positive] * len(at)
                        out["vec_id"] += lot.ids[at].tolist()
                        out["score"] += scores.tolist()
                        out["n"] += n.tolist()
                kinds = pa.schema([(c, pa.int64()) for c in out])
                yield pa.RecordBatch.from_pydict(out, kinds)

    return both.mapInArrow(search, "anchor bigint, positive bigint, vec_id bigint, score bigint, n bigint")


def leaders(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One row a key: `rows`, the first k (vec_id, score), equal rows repeated."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    first = found.withColumn("place", place).where(F.col("place") <= k)
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "n"))).alias("_rows"))
    copies = F.transform("_rows", lambda r: F.array_repeat(F.struct(r["vec_id"].alias("vec_id"), r["score"].alias("score")), F.least(r["n"], F.lit(k)).cast("int")))
    return listed.select(*keys, F.slice(F.flatten(copies), 1, k).alias("rows"))


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, focus: int = 5, lot_values: int = 1 << 18) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows
    whose vec_id is divisible by `every`."""
    lots = stage(in_lots(points(rows), lot_values), "lots")
    buckets = stage(lots.groupBy(*LOT).agg(F.max("length").alias("longest")), "buckets")
    anchors = stage(lots.where(F.col("vec_id") % every == 0).withColumn("anchor", F.xxhash64("vec_id", "label", "vector")), "anchors")
    nothing, none = F.array().cast("array<bigint>").alias("positives"), F.lit(None).cast("double").alias("least")
    told = ["anchor", "vec_id", "vector"]

    home = stage(searched(lots, anchors.select(*LOT, *told, none, nothing), positives, focus), "home")
    bound = leaders(home, ["anchor"], positives).select(
        "anchor", F.when(F.size("rows") >= positives, F.element_at("rows", -1)["score"]).cast("double").alias("least")
    )
    waiting = anchors.withColumnRenamed("lot", "_home").join(bound, "anchor", "left")

    def reached(least: Column) -> Column:
        return least.isNull() | (F.col("length") * F.col("longest") * (1 + 1e-9) >= least)

    more = salted_join(waiting, buckets, ["label", "dims"]).where(reached(F.col("least")) & (F.col("lot") != F.col("_home")))
    away = searched(lots, more.select(*LOT, *told, "least", nothing), positives, focus)
    leading = leaders(home.unionByName(away), ["anchor"], positives)
    paired = stage(anchors.join(leading, "anchor"), "positives")

    # Positives below zero have an empty window.
    asked = F.array_distinct(F.filter(F.transform("rows", lambda r: r["score"]), lambda s: s >= 0))
    mining = paired.withColumn("positives", asked).where(F.size("positives") > 0).withColumnRenamed("label", "_label").drop("lot", "rows")
    other = salted_join(mining, buckets, ["dims"]).where((F.col("label") != F.col("_label")) & reached(0.8 * F.array_min("positives")))
    mined = leaders(searched(lots, other.select(*LOT, *told, none, "positives"), negatives, focus), ["anchor", "positive"], negatives)
    pairs = paired.select("anchor", F.col("vec_id").alias("anchor_id"), "n", F.explode("rows").alias("_positive")).withColumn("positive", F.col("_positive.score"))
    return (
        pairs.join(mined, ["anchor", "positive"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
        .select("anchor_id", "_positive", "positive", F.posexplode("rows").alias("_place", "_negative"))
        .select(
            "anchor_id", F.col("_positive.vec_id").alias("positive_id"), (F.col("_place") + 1).cast("int").alias("rank"),
            F.col("_negative.vec_id").alias("negative_id"), F.col("positive").alias("positive_score"), F.col("_negative.score").alias("negative_score"),
        )
    )
