"""Embedding near-dedup: spherical k-means cells, blocked cosines of packs, one row a group.

Rows with equal label and equal vector are one point with a count. Cells are unit centres, fitted
on a bounded sample of points; every point is at home in its nearest cell. Points are dealt into
ranges of label and cell once and written as packs: some megabytes of vectors of one label, in the
order of their cells. Packs of one label then meet pair by pair in tasks that read them from the
written index, so no vector is shuffled or written a second time, however many cells it can have
links in; what a pair of packs holds in memory is bounded. Of a pair, blocks of `block` points are
multiplied, without the points that can have no link in the other block's cells (see `visiting`).
Of the links only counts by point and a spanning forest leave a task.

Cosines are in double precision; products in single precision only leave out what is below the
bound by more than their error. No linked pair is missed. Where vectors crowd around no centres
the bound leaves out few cells, and the work comes near to that of all pairs of a label.

Defined cases: rows with a null label, a null or zero vector, or a null or non-finite component
link with nothing and are their own component; so do rows with a null vec_id, whose component is
null. Rows with one vec_id and different vectors link apart. Vectors of different lengths do not link. Equal rows are counted as others to each other.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FloatType

from longspan.llm.batches import slices
from longspan.llm.components import components, join_up
from longspan.sources.stages import stage

#: Bytes of vectors in a pack, and in a partition of packs.
PACK_BYTES, PART_BYTES = 1 << 21, 1 << 25
#: Linked points that a task holds before it merges them.
HELD = 1 << 19


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix; its lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each unit vector; equal vectors get the same one, whatever stands beside them."""
    homes = [np.zeros(0, np.int64)]
    for k in range(0, len(x), 1024):
        near = x[k : k + 1024] @ centres.T
        home = near.argmax(1)
        close = near >= near.max(1)[:, None] - 1e-9
        # The last digits of a product depend on the row's place in the block.
        for row in np.flatnonzero(close.sum(1) > 1):
            some = np.flatnonzero(close[row])
            home[row] = some[(centres[some] * x[k + row]).sum(1).argmax()]
        homes.append(home)
    return np.concatenate(homes)


def in_order(centres: np.ndarray) -> np.ndarray:
    """An order in which runs of centres lie near each other: halves along the widest axis, again and again."""
    done, todo = [], [np.arange(len(centres))]
    while todo:
        lot = todo.pop()
        if len(lot) > 2:
            axis = np.ptp(centres[lot], axis=0).argmax()
            lot = lot[np.argsort(centres[lot, axis], kind="stable")]
            todo += [lot[len(lot) // 2 :], lot[: len(lot) // 2]]
        else:
            done.append(lot)
    return np.concatenate(done)


def fit_cells(rows: DataFrame, total: int, n: int, fit_points: int, rounds: int = 8) -> dict[int, np.ndarray]:
    """Unit centres by vector length, from about `fit_points` of `total` rows picked by hash, equal ones once."""
    spot = F.shiftrightunsigned("hash", 11) / float(1 << 53)
    sample = rows.where(spot < float(fit_points) / max(total, 1)).select("hash", "embedding").distinct().toPandas()
    sample = sample.sort_values("hash", kind="stable")
    cells = {}
    for size, lot in sample.groupby(sample["embedding"].map(len)):
        x = unit(np.stack(lot["embedding"].to_numpy()).astype(np.float64))
        centres = x[:: max(1, len(x) // n)][:n].copy()
        for _ in range(rounds):
            near = nearest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            some = np.linalg.norm(sums, axis=1) > 1e-9
            centres[some] = unit(sums[some])
        cells[int(size)] = centres[in_order(centres)]
    return cells


def visiting(x: np.ndarray, home: np.ndarray, some: np.ndarray, centres: np.ndarray, cosine: float) -> np.ndarray:
    """Whether each unit vector, at home in `home`, visits each of the cells `some`.

    A link lies within t, the angle of `cosine`. Its home is no nearer to the point than the plane
    between the two centres, so the point is within t of that plane. And of two linked points the
    one farther from its home is, by the triangle rule, at most t farther from the other's home:
    so of two linked points one visits the other's home.
    """
    reach = np.arccos(np.clip(cosine, -1, 1)) + 2e-6
    width = np.sin(reach) if reach < np.pi / 2 else 1e9
    kinds, kind = np.unique(home, return_inverse=True)
    apart = np.sqrt(np.maximum(2 - 2 * centres[kinds] @ centres[some].T, 0))
    close = np.zeros((len(x), len(some)), bool)
    for k in range(0, len(x), 1024):
        part = slice(k, k + 1024)
        near = np.clip(x[part] @ centres[some].T, -1, 1)
        own = np.clip((x[part] * centres[home[part]]).sum(1), -1, 1)[:, None]
        least = np.cos(np.minimum(np.arccos(own) + reach, np.pi))
        close[part] = (own - near <= width * apart[kind[part]] + 1e-9) & (near >= least - 1e-9)
    return close


def place(part: pa.RecordBatch, cells: dict[int, np.ndarray], cosine: float) -> pa.RecordBatch:
    """Add `visits`: the cells of each point, its home first."""
    sizes = np.diff(part.column("embedding").offsets.to_numpy())
    visits: list[list[int]] = [[0]] * part.num_rows  # one cell for a length that the sample lacks
    for size in np.unique(sizes):
        if int(size) in cells:
            at, centres = np.flatnonzero(sizes == size), cells[int(size)]
            x = unit(vectors(part.column("embedding").take(pa.array(at))).astype(np.float64))
            home = nearest(x, centres)
            close = visiting(x, home, np.arange(len(centres)), centres, cosine)
            close[np.arange(len(x)), home] = False
            for k, own, others in zip(at, home, close):
                visits[k] = [int(own), *np.flatnonzero(others).tolist()]
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(visits, pa.list_(pa.int32()))], [*part.schema.names, "visits"])


def by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with one key, from batches ordered by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in key])
        turns = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1
        for a, b in zip([0, *turns], [*turns, batch.num_rows]):
            now = tuple(keys[:, a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def in_bytes(x: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of rows of a matrix as binary values; `starts` ends with the number of rows."""
    ends = (starts * x.itemsize * x.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def of_bytes(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, dims)


def once(x: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, and the number of rows; in `same` they are equal too."""
    turns = (x[1:] != x[:-1]).any(1)
    for c in same:
        turns |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(turns) + 1, [len(x)]])


def homed(part: pa.RecordBatch, cells: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows as points with their home; copies that meet here are taken together."""
    sizes = np.diff(part.column("embedding").offsets.to_numpy())
    for size in np.unique(sizes):
        lot = part.take(pa.array(np.flatnonzero(sizes == size)))
        label, hashed = lot.column("label").to_numpy(), lot.column("hash").to_numpy()
        order = np.lexsort((hashed, label))
        x = vectors(lot.column("embedding"))[order] + 0  # zero has one sign
        starts = once(x, label[order], hashed[order])
        first = order[starts[:-1]]
        x = x[starts[:-1]]
        home = nearest(unit(x.astype(np.float64)), cells[int(size)]) if int(size) in cells else np.zeros(len(x))
        yield pa.RecordBatch.from_pydict(
            {
                "label": label[first],
                "dims": np.full(len(x), size, np.int32),
                "cell": home.astype(np.int32),
                "hash": hashed[first],
                "other": lot.column("other").to_numpy()[first],
                "vector": in_bytes(x, np.arange(len(x) + 1)),
                "n": np.diff(starts),
                "least_id": np.minimum.reduceat(lot.column("vec_id").to_numpy()[order], starts[:-1]),
            }
        )


def packed(run: pa.Table, kind: str, first: int, block: int) -> pa.RecordBatch:
    """The points of one label and length, ordered by cell and vector, in packs; they are numbered
    from `first` on. Only points with copies keep their hashes."""
    run = run.combine_chunks()
    dims = run.column("dims")[0].as_py()
    x = np.concatenate([of_bytes(c, kind, dims) for c in run.column("vector").chunks])
    starts = once(x)
    point = starts[:-1]
    n = np.add.reduceat(run.column("n").to_numpy(), point)
    most = max(min(block, 512), min(4 * block, PACK_BYTES // (x.itemsize * dims)))
    edges = np.append(np.arange(0, len(point), most), len(point))

    def listed(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)

    packs = len(edges) - 1
    return pa.RecordBatch.from_pydict(
        {
            "label": np.repeat(run.column("label").to_numpy()[:1], packs),
            "dims": np.full(packs, dims, np.int32),
            "first": first + edges[:-1],
            "cells": listed(pa.array(run.column("cell").to_numpy()[point])),
            "vectors": in_bytes(x[point], edges),
            "n": listed(pa.array(n)),
            "least_id": listed(pa.array(np.minimum.reduceat(run.column("least_id").to_numpy(), point))),
            **{c: listed(pa.array(run.column(c).to_numpy()[point], mask=n == 1)) for c in ("hash", "other")},
        }
    )


class Pack:
    """The points of one row of the index."""

    def __init__(self, batch: pa.RecordBatch, row: int, kind: str, cells: dict[int, np.ndarray], side: str = ""):
        self.first, self.dims = (batch.column(side + c)[row].as_py() for c in ("first", "dims"))
        self.home, self.n = (batch.column(side + c)[row].values.to_numpy() for c in ("cells", "n"))
        self.x = np.frombuffer(batch.column(side + "vectors")[row].as_buffer(), kind).reshape(-1, self.dims).astype(np.float64)
        self.length = np.linalg.norm(self.x, axis=1)
        self.unit = self.x / self.length[:, None]
        self.thin = self.unit.astype(np.float32)
        self.kinds, self.kind = np.unique(self.home, return_inverse=True)
        self.centres = cells.get(self.dims)

    def visitors(self, other: Pack, cosine: float) -> np.ndarray | None:
        """By point and cell of the other pack, who visits there; None where asking would cost as much as comparing."""
        if self.centres is None or 8 * len(other.kinds) > len(other.home):
            return None
        return visiting(self.unit, self.home, other.kinds, self.centres, cosine)


def near(a: Pack, b: Pack, p: np.ndarray, q: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The linked ones of the points p of a and q of b; of one pack those with the smaller place first."""
    right = b.thin[q].T
    least = np.float32(cosine - (a.dims + 8) * 2.0**-23)  # a product of unit vectors is not farther off
    for k in range(0, len(p), 256):
        rows = p[k : k + 256]
        close = np.flatnonzero(a.thin[rows] @ right >= least)
        if 32 * len(close) > len(rows) * len(q):
            exact = a.x[rows] @ b.x[q].T / (a.length[rows][:, None] * b.length[q]) >= cosine
            i, j = (at[spot] for at, spot in zip((rows, q), np.nonzero(exact)))
        else:
            i, j = (at[spot] for at, spot in zip((rows, q), np.divmod(close, len(q))))
            exact = [(a.x[i[m : m + 4096]] * b.x[j[m : m + 4096]]).sum(1) for m in range(0, len(i), 4096)]
            some = np.concatenate([*exact, []]) / (a.length[i] * b.length[j]) >= cosine
            i, j = i[some], j[some]
        if a is b:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def met_points(a: Pack, b: Pack, cosine: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked points of two packs, or of one: of each pair of blocks the points that visit
    a cell of the other block meet all of it, and the others those that visit a cell of theirs."""
    to_b = a.visitors(b, cosine)
    to_a = to_b if a is b else b.visitors(a, cosine)
    for i in range(0, len(a.home), block):
        p = np.arange(i, min(i + block, len(a.home)))
        for j in range(i if a is b else 0, len(b.home), block):
            q = np.arange(j, min(j + block, len(b.home)))
            if to_a is None or to_b is None:
                yield from near(a, b, p, q, cosine)
                continue
            guest = to_b[p, b.kind[j] : b.kind[q[-1]] + 1].any(1)
            yield from near(a, b, p[guest], q, cosine)
            if not guest.all():
                host = to_a[q, a.kind[i] : a.kind[p[-1]] + 1].any(1)
                yield from near(a, b, p[~guest], q[host], cosine)


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def links(a: Pack, b: Pack, cosine: float, block: int) -> Iterator[Found]:
    """For linked points: how many rows they link with here, and a point of their tree."""
    offset = 0 if a is b else len(a.home)
    point = a.first + np.arange(len(a.home))
    n = a.n
    if a is not b:
        point, n = np.concatenate([point, b.first + np.arange(len(b.home))]), np.concatenate([n, b.n])

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> Found:
        p, q = (np.concatenate(c) for c in zip(*held))
        counts = (np.bincount(p, n[q], len(n)) + np.bincount(q, n[p], len(n))).astype(np.int64)
        some = counts > 0
        return point[some], counts[some], point[join_up(np.arange(len(n)), p, q)[some]]

    held, size = [], 0
    for p, q in met_points(a, b, cosine, block):
        held.append((p, q + offset))
        size += len(p)
        if size > HELD:
            yield summed(held)
            held, size = [], 0
    if held:
        yield summed(held)


def merged(found: Iterator[Found]) -> Iterator[pa.RecordBatch]:
    """Counts and trees of a task taken together, so that a point leaves it about once."""
    held, size = [], 0

    def together() -> Found:
        point, n, root = (np.concatenate(c) for c in zip(*held))
        names, at = np.unique(np.concatenate([point, root]), return_inverse=True)
        counts = np.zeros(len(names), np.int64)
        np.add.at(counts, at[: len(point)], n)
        return names, counts, names[join_up(np.arange(len(names)), at[: len(point)], at[len(point) :])]

    for some in found:
        held.append(some)
        size += len(some[0])
        if size > HELD:
            held = [together()]
            size = 0
            if len(held[0][0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["point", "n", "root"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in together()], ["point", "n", "root"])


def _usable() -> Column:
    """Whether a row can link; never null."""
    # NaN is above all numbers.
    fine = F.forall("embedding", lambda v: v.isNotNull()) & (F.array_max("embedding") < float("inf")) & (F.array_min("embedding") > float("-inf"))
    some = (F.array_min("embedding") != 0) | (F.array_max("embedding") != 0)
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return whole & F.coalesce(fine & some, F.lit(False))


def met(packs: DataFrame, value_bytes: int) -> DataFrame | None:
    """Pairs of packs of one label and length, columns a_* and b_*; None if there are none.

    Tasks read pairs of partitions of the written packs, nothing is shuffled."""
    several = packs.groupBy("label", "dims").agg(F.count("*").alias("packs"), F.sum(F.size("n") * F.col("dims")).alias("_values")).where("packs > 1")
    several = stage(several, "several")  # fewer rows than full packs and ranges
    size = several.agg(F.sum("packs"), F.sum("_values")).first()
    if size[0] is None:
        return None
    parts = max(math.sqrt(8 * packs.sparkSession.sparkContext.defaultParallelism), size[1] * value_bytes / PART_BYTES)
    many = packs.select("label", "dims", "first", "cells", "vectors", "n").join(F.broadcast(several.select("label", "dims")), ["label", "dims"], "left_semi")
    a, b = (many.coalesce(math.ceil(min(parts, size[0]))).select([F.col(c).alias(side + c) for c in many.columns]) for side in ("a_", "b_"))
    one_label = (F.col("a_label") == F.col("b_label")) & (F.col("a_dims") == F.col("b_dims"))
    return a.hint("shuffle_replicate_nl").join(b, one_label & (F.col("a_first") < F.col("b_first")))


def embedding_groups(
    rows: DataFrame,
    cosine: float = 0.93,
    cell_points: int = 1500,
    most_cells: int = 4096,
    block: int = 2048,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row. There is a cell for each `cell_points`
    rows, up to `most_cells` (which bounds the centres that are sent out), fitted on about 16
    points each."""
    spark = rows.sparkSession
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    narrow = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    kind, width = ("float32", 4) if narrow else ("float64", 8)
    able = own.where(_usable()).select("vec_id", F.xxhash64("label").alias("label"), F.col("embedding").cast("array<float>" if narrow else "array<double>"))
    able = able.withColumns({"hash": F.xxhash64("label", "embedding"), "other": F.xxhash64(F.lit(9), "label", "embedding")})
    total, values = able.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    n = min(most_cells, max(16, total // cell_points))
    sent = spark.sparkContext.broadcast(fit_cells(able, total, n, 16 * n))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            yield from homed(part, sent.value)

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        for run in by_key(batches, ["label", "dims"]):
            packs = packed(run, kind, first, block)
            first += len(packs.column("n").values)
            yield packs

    # Ranges and not hashes, so that a hot label or cell is split; equal vectors stay together.
    place_of = ["label", "dims", "cell", "hash"]
    points = able.mapInArrow(placed, "label bigint, dims int, cell int, hash bigint, other bigint, vector binary, n bigint, least_id bigint")
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(values * width / (PART_BYTES // 2)))
    kinds = "label bigint, dims int, first bigint, cells array<int>, vectors binary, n array<bigint>, least_id array<bigint>, hash array<bigint>, other array<bigint>"
    ordered = points.repartitionByRange(ranges, *place_of).sortWithinPartitions(*place_of, "vector")
    packs = stage(ordered.mapInArrow(packing, kinds), "packs")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (Pack(batch, k, kind, sent.value) for batch in batches for k in range(batch.num_rows))
        yield from merged(found for a in every for found in links(a, a, cosine, block))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[Found]:
            a = None
            for batch in batches:
                for k in range(batch.num_rows):
                    if a is None or a.first != batch.column("a_first")[k].as_py():
                        a = Pack(batch, k, kind, sent.value, "a_")
                    yield from links(a, Pack(batch, k, kind, sent.value, "b_"), cosine, block)

        yield from merged(pairs())

    linked = "point bigint, n bigint, root bigint"
    found = packs.select("dims", "first", "cells", "vectors", "n").mapInArrow(within, linked)
    if (pairs := met(packs, width)) is not None:
        found = found.unionByName(pairs.mapInArrow(between, linked))
    found = stage(found, "links")
    counts = found.groupBy("point").agg(F.sum("n").alias("links"))
    roots = components(found.select(F.col("point").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "point")
    listed = packs.select("first", F.posexplode(F.arrays_zip("n", "least_id", "hash", "other")).alias("_at", "_point"))
    points = listed.select((F.col("first") + F.col("_at")).alias("point"), "_point.*")
    linked = stage(counts.join(roots, "point").join(points.select("point", "least_id"), "point"), "linked")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = points.join(linked.join(least, "root").select("point", "links", "component_id"), "point", "left").select(
        "hash", "other", "n", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "least_id").alias("component_id"),
    )
    # Points without copies need no second look at the rows; the others are found by 128 bits of label and vector.
    result = named.where("n = 1").selectExpr("least_id as vec_id", "n_links", "component_id")
    if not packs.where(F.exists("n", lambda k: k > 1)).isEmpty():
        several = able.select("vec_id", "hash", "other").join(named.where("n > 1"), ["hash", "other"])
        result = result.unionByName(several.select("vec_id", "n_links", "component_id"))
    alone = own.where(~_usable()).selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    result = result.unionByName(alone)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
