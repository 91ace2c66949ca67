"""SimHash near-dedup: documents whose fingerprints differ in a few bits, by pivot distance tables.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's 3-word shingles.
Equal fingerprints are one node from then on, however many documents share them.

Candidates: the 64 bits are cut into `distance` + 4 parts, and a fingerprint goes into one group
for each choice of parts that leaves `distance` out. Two fingerprints within the distance agree on
such a choice. For the distance 2 a group fixes at least 42 bits, so it has at most 2**22 members
whatever the data. In a group each fingerprint has a row of Hamming distances to fixed reference
fingerprints. By the triangle inequality a pair whose rows differ by more than the distance
anywhere is no link: the group is ordered by the first coordinate, only a sliding stretch of it is
paired, the largest difference over the other coordinates discards more, and the survivors are
verified. Each task gives a spanning forest of its links, so rows out never exceed rows in.

Defined cases: a null text and a text without words have fingerprint 0, linked like any other. Rows
with one doc_id each give a row; a null doc_id is never a component's name, and a component of
such rows only has a null name. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from longspan.llm.batches import slices, texts
from longspan.llm.components import components, join_up
from longspan.sources.stages import stage

SEED = 42
SHINGLE = 3
PIVOTS = 16


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of a text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    width = min(SHINGLE, len(words))
    pieces, digest = zip(starts, ends[width - 1 :]), xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in pieces], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        lot = hashes[k : k + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(lot, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """Fixed, well spread 64-bit values."""
    return np.array([xxhash.xxh64_intdigest(b"%d" % k, SEED) for k in range(n)], np.uint64)


def masks(distance: int) -> list[int]:
    """Bits that a group fixes, for each choice of parts to leave out."""
    parts = distance + 4
    edges = [64 * k // parts for k in range(parts + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(whole) - sum(out) for out in combinations(whole, distance)]


def links_within(group: np.ndarray, prints: np.ndarray, distance: int, pivots: np.ndarray) -> np.ndarray:
    """Smallest place linked to each place, directly or not; `group` is sorted."""
    table = np.stack([np.bitwise_count(prints ^ p) for p in pivots]).astype(np.int16)
    order = np.lexsort((table[0], group))
    group, prints, table = group[order], prints[order], table[:, order]
    parent, near, step = np.arange(len(group)), np.arange(len(group)), 0
    while len(near):
        step += 1
        near = near[near + step < len(group)]
        near = near[(group[near] == group[near + step]) & (table[0, near + step] - table[0, near] <= distance)]
        a, b = near, near + step
        for row in table[1:]:
            close = np.abs(row[a] - row[b]) <= distance
            a, b = a[close], b[close]
        same = np.bitwise_count(prints[a] ^ prints[b]) <= distance
        parent = join_up(parent, a[same], b[same])
    found = np.empty(len(group), np.int64)
    found[order] = order[parent]
    return found


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (bigint with the fingerprint's bits) for each row."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "fingerprint": found.view(np.int64)})

    return texts(docs).mapInArrow(mapped, "doc_id bigint, fingerprint bigint")


def link_edges(prints: DataFrame, distance: int) -> DataFrame:
    """Edges a, b that span the links among distinct values of the column `fingerprint`."""
    fixed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks(distance)])
    routed = (
        prints.select("fingerprint", F.posexplode(fixed).alias("choice", "mask"))
        .select("fingerprint", "choice", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("bits"))
        .repartition("choice", "bits")
        .sortWithinPartitions("choice", "bits")
    )
    pivots = reference_fingerprints()

    def edges(rows: np.ndarray, choice: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        new = (np.diff(choice, prepend=choice[:1]) != 0) | (np.diff(bits, prepend=bits[:1]) != 0)
        group = np.cumsum(new)
        crowd = np.bincount(group)[group] > 1
        rows, group = rows[crowd], group[crowd]
        parent = links_within(group, rows.view(np.uint64), distance, pivots) if len(rows) else np.zeros(0, np.int64)
        linked = parent != np.arange(len(rows))
        return pa.RecordBatch.from_pydict({"a": rows[linked], "b": rows[parent[linked]]})

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            lot = [batch.column(k).to_numpy() for k in range(3)]
            # The last group may go on in the next batch.
            last = (lot[1] == lot[1][-1]) & (lot[2] == lot[2][-1])
            cut = len(last) - int(last.sum())
            if cut or held and (lot[1][0], lot[2][0]) != (held[-1][1][-1], held[-1][2][-1]):
                yield edges(*map(np.concatenate, zip(*held, [x[:cut] for x in lot])))
                held = []
            held.append([x[cut:] for x in lot])
        if held:
            yield edges(*map(np.concatenate, zip(*held)))

    return routed.select("fingerprint", "choice", "bits").mapInArrow(paired, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (bigint) and component_id for each row."""
    prints = stage(fingerprints(docs), "fingerprints")
    distinct = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(link_edges(distinct, distance)).select(F.col("node").alias("fingerprint"), "root")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(rooted.join(names, "root").select("fingerprint", "component_id"), "named")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The rows, as they are, of the smallest doc_id of each group; equal rows stay once.

    Where no row of a group has a doc_id, all its different texts stay.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    groups = simhash_groups(docs, distance)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("key")).distinct()
    packed = docs.select(key.alias("key"), F.xxhash64("text").alias("digest"), F.struct("*").alias("row"))
    place = F.row_number().over(W.partitionBy("key", "digest").orderBy("key"))
    kept = packed.join(first, "key", "left_semi").withColumn("place", place).where("place = 1")
    return kept.select("row.*")
