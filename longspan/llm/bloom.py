"""Two Bloom filters over 64-bit hashes: seen once, and seen again.

The hashes are dealt into segments by value, and one task fills both filters of a segment while it
streams the hashes past: a hash that the first filter already holds goes into the second. A hash
that occurs twice is always in the second filter; others are in it by chance. Only the second one
leaves the tasks. Its size follows the number of hashes up to `most_bytes`, which bounds what the
driver holds and sends out; beyond that the filter lets more hashes through, so callers confirm
what it passes and results never depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from longspan.sources.stages import stage

PROBES = 6
BITS_EACH = 12
MOST_BYTES = 32 << 20


def at_most_twice(hashes: np.ndarray) -> np.ndarray:
    """Each hash once, and once more if it repeats: all that the filters need of a batch."""
    distinct, counts = np.unique(hashes, return_counts=True)
    return np.concatenate([distinct, distinct[counts > 1]])


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions of each hash within its segment, one array for each probe."""
    h = hashes.view(np.uint64).copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64(bits - 1)
    return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(PROBES)]


def _held(filled: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    held = filled[places[0]].astype(bool)
    for at in places[1:]:
        held &= filled[at].astype(bool)
    return held


@dataclass
class SeenTwice:
    """The second filter: packed bits by segment."""

    packed: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        segments, width = self.packed.shape
        if not len(hashes) or not width:
            return np.zeros(len(hashes), bool)
        row = (hashes.view(np.uint64) % np.uint64(segments)).astype(np.int64) * width
        flat, held = self.packed.reshape(-1), np.ones(len(hashes), bool)
        for at in _places(hashes, width * 8):
            held &= (flat[row + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return held


def seen_twice(hashes: DataFrame, most_bytes: int = MOST_BYTES) -> SeenTwice:
    """Filter of the values of the bigint column `h` that occur more than once."""
    spark = hashes.sparkSession
    hashes = stage(hashes, "hashes")
    rows = hashes.count()
    segments = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = 1 << max(9, (BITS_EACH * rows // segments).bit_length())
    while each > 512 and segments * each > most_bytes * 8:
        each //= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).to_numpy()
            lot = (values.view(np.uint64) % np.uint64(segments)).astype(np.int64)
            for k in np.unique(lot):
                first = once.setdefault(int(k), np.zeros(each, np.uint8))
                second = twice.setdefault(int(k), np.zeros(each, np.uint8))
                distinct, counts = np.unique(values[lot == k], return_counts=True)
                places = _places(distinct, each)
                again = _held(first, places) | (counts > 1)
                for at in places:
                    first[at] = 1
                    second[at[again]] = 1
        for k, second in twice.items():
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([k], pa.int32()), "bits": [np.packbits(second).tobytes()]}
            )

    # The remainder of the unsigned value, from signed arithmetic.
    wrap = (1 << 64) % segments
    lot = F.pmod(F.pmod(F.col("h"), F.lit(segments)) + F.when(F.col("h") < 0, wrap).otherwise(0), F.lit(segments))
    filled = hashes.repartition(segments, lot).mapInArrow(fill, "segment int, bits binary")
    packed = np.zeros((segments, each // 8), np.uint8)
    for row in filled.toLocalIterator():
        packed[row.segment] = np.frombuffer(row.bits, np.uint8)
    return SeenTwice(packed)
