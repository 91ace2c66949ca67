"""Line dedup: frequent lines are kept in one document only.

A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least
`least_points` code points that occur in at least `least_docs` documents lose all their lines but
those in the largest doc_id that holds them.

The texts are read twice. The first pass fills two Bloom filters (`bloom.py`) with key hashes; the
second sends on only keys that the "seen twice" filter holds. Those are counted exactly by a
128-bit digest, and the digests to drop go back to their documents. Texts without a suspect line
are finished where they are read and never shuffled.

Defined cases: a null or empty text is one empty line. Rows with one doc_id are one document in
the counts, and each row gives a row; a null doc_id is a document smaller than all others. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from longspan.llm.batches import slices, table, texts
from longspan.llm.bloom import MOST_BYTES, at_most_twice, seen_twice
from longspan.sources.stages import stage

WHITE = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id, below all others.
NO_ID = -(1 << 63)


def keys(text: bytes | None, least_points: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines, and the key of each line that is long enough."""
    lines = (text or b"").split(b"\n")
    found: list[bytes | None] = []
    for line in lines:
        key = None
        if len(line) >= least_points:
            key = line.strip(WHITE).lower()
            if len(key) < least_points or not key.isascii() and len(key.decode("utf-8", "replace")) < least_points:
                key = None
        found.append(key)
    return lines, found


def hashes_of(found: list[bytes | None]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in found if k is not None], np.uint64).view(np.int64)


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def line_dedup(
    docs: DataFrame, least_points: int = 40, least_docs: int = 5, filter_bytes: int = MOST_BYTES
) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and kept_text for each row."""
    spark = docs.sparkSession
    source = texts(docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            lots = [np.unique(hashes_of(keys(t, least_points)[1])) for t in part.column(1).to_pylist()]
            yield table(h=at_most_twice(np.concatenate(lots)))

    seen = spark.sparkContext.broadcast(seen_twice(source.mapInArrow(hashed, "h bigint"), filter_bytes))

    def suspects_of(text: bytes | None) -> set[bytes]:
        found = [k for k in keys(text, least_points)[1] if k is not None]
        return {digest(k) for k, held in zip(found, seen.value.holds(hashes_of(found))) if held}

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            docs_out, keys_out = [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                lot = suspects_of(text)
                docs_out += [NO_ID if doc is None else doc] * len(lot)
                keys_out += lot
            yield table(doc=pa.array(docs_out, pa.int64()), key=pa.array(keys_out, pa.binary()))

    suspects = stage(source.mapInArrow(suspected, "doc bigint, key binary"), "suspects")
    frequent = (
        suspects.groupBy("key")
        .agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= least_docs)
    )
    # Written, so that the join's two sides are plain shuffles and Spark can split a frequent key.
    frequent = stage(frequent, "frequent")
    drops = (
        suspects.join(frequent, "key")
        .where("doc <> keeper")
        .groupBy("doc")
        .agg(F.collect_set("key").alias("drops"))
    )

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = part.column(1).to_pylist()
            yield table(
                doc_id=part.column(0),
                doc=[NO_ID if d is None else d for d in part.column(0).to_pylist()],
                text=pa.array([t or b"" for t in values], pa.binary()),
                suspect=[bool(suspects_of(t)) for t in values],
            )

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(part.column("text").to_pylist(), part.column("drops").to_pylist()):
                lines, found = keys(text, least_points)
                n_lines.append(len(lines))
                if drop:
                    drop = set(drop)
                    left = [a for a, k in zip(lines, found) if k is None or digest(k) not in drop]
                else:
                    left = lines
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            yield table(
                doc_id=part.column("doc_id"),
                n_lines=pa.array(n_lines, pa.int64()),
                n_dropped=pa.array(n_dropped, pa.int64()),
                kept_text=pa.array(kept, pa.binary()),
            )

    out = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text binary"
    read = source.mapInArrow(prepared, "doc_id bigint, doc bigint, text binary, suspect boolean")
    clean = read.where("not suspect").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("drops"))
    dirty = read.where("suspect").join(drops, "doc", "left").select("doc_id", "text", "drops")
    result = clean.unionByName(dirty).mapInArrow(finished, out)
    return result.withColumn("kept_text", F.col("kept_text").cast("string"))
