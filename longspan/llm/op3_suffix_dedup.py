"""Suffix-array dedup: bytes covered by a long string that also starts somewhere else.

Every `window`-byte string of a document is given to one anchor in it: the least of the hashes of
its `gram`-byte strings, the leftmost of equals. The choice depends on the string alone, so equal
windows have anchors with equal hashes at equal places. The windows of one anchor are consecutive;
together they are its segment. Only anchors whose hash occurs again matter, and a pair of Bloom
filters (`bloom.py`) keeps the others where they are.

Equal segments of an anchor hash are counted first, so a group of copies is one segment. The
different segments of a hash, those that are repeated twice, form a small text of which a suffix
array is made (`suffix_groups.py`). A window that shares its first `window` bytes with a neighbour
in the array is repeated. Anchor hashes with more than `crowd` different segments (text around
which very many documents differ) do not fit one task: their windows are dealt out by a 128-bit
digest, and windows of one digest in different segments are repeated. Both ways are exact.

Repeated starts go back to the documents that hold the segment, and covered bytes are cut out
there. Texts without a suspected anchor are finished where they are read.

Defined cases: a null text is empty; texts shorter than a window keep all. Rows are told apart by
doc_id and text, and equal rows are copies of each other. What is left is bytes, as a cut may part
a character. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from longspan.llm.batches import slices, texts
from longspan.llm.bloom import MOST_BYTES, at_most_twice, seen_twice
from longspan.llm.suffix_groups import suffix_arrays
from longspan.sources.stages import stage

WINDOW = 200
GRAM = 64
#: Window starts looked at together in a long text, and bytes of short texts side by side.
STRETCH, TOGETHER = 1 << 18, 1 << 16
BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@cache
def _byte_values() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 3) for b in range(256)], np.uint64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _anchors_in(line: np.ndarray, begin: int, end: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams from `begin`, and for each window start up to `end` the place of its anchor."""
    part = line[begin : end + window - 1]
    up, down = _powers(1 << (len(part) - 1).bit_length())
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_byte_values()[part] * up[: len(part)], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    ranked = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    return hashes, (_least(ranked, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, and the first and last start of its windows."""
    return anchors_of([text], window, gram)[1:]


def anchors_of(
    lines: list[bytes], window: int = WINDOW, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The place of the text in the list, then what `anchors` gives for it, over all texts.

    Short texts are looked at side by side; a text longer than a stretch alone, a stretch at a time.
    """
    found: list[tuple[np.ndarray, ...]] = []
    lot: list[int] = []
    size = 0

    def flush() -> None:
        if not lot:
            return
        line = np.frombuffer(b"".join([lines[k] for k in lot]), np.uint8)
        sizes = np.array([len(lines[k]) for k in lot])
        ends = np.cumsum(sizes)
        hashes, at = _anchors_in(line, 0, len(line), window, gram)
        # No window may reach beyond its own text, so neighbours in different texts differ in anchor.
        fits = np.ones(len(line), bool)
        for end in ends:
            fits[end - window + 1 : end] = False
        starts = np.flatnonzero(fits)
        turns = np.flatnonzero(np.diff(at[starts])) + 1
        first, last = np.concatenate([[0], turns]), np.concatenate([turns, [len(starts)]]) - 1
        text = np.searchsorted(ends, starts[first], "right")
        before = (ends - sizes)[text]
        found.append((np.array(lot)[text], hashes[at[starts[first]]].view(np.int64), starts[first] - before, starts[last] - before))

    for k, own in enumerate(lines):
        if len(own) < window:
            continue
        if len(own) > STRETCH:
            line = np.frombuffer(own, np.uint8)
            for begin in range(0, len(line) - window + 1, STRETCH):
                hashes, at = _anchors_in(line, begin, begin + STRETCH, window, gram)
                turns = np.flatnonzero(np.diff(at)) + 1
                first, last = np.concatenate([[0], turns]), np.concatenate([turns, [len(at)]]) - 1
                found.append((np.full(len(first), k), hashes[at[first]].view(np.int64), first + begin, last + begin))
            continue
        if size + len(own) > TOGETHER:
            flush()
            lot, size = [], 0
        lot.append(k)
        size += len(own)
    flush()
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Bytes of segments that are put into suffix arrays together.
BUNDLE = 2 << 20
RUNS = "f bigint, dg bigint, a int, b int"


def runs_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive sorted numbers."""
    turns = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], turns])], starts[np.concatenate([turns, [len(starts)]]) - 1]


def repeated_starts(groups: list[list[bytes]], window: int) -> list[list[np.ndarray]]:
    """For each segment of each group: the starts whose window occurs again in the group."""
    parts: list[np.ndarray] = []
    for group in groups:
        for segment in group:
            parts += [np.frombuffer(segment, np.uint8).astype(np.int32) + 2, np.ones(1, np.int32)]
        parts.append(np.zeros(1, np.int32))
    symbols = np.concatenate(parts)
    sizes = np.array([sum(map(len, g)) + len(g) + 1 for g in groups])
    ends = np.cumsum(sizes)
    order = suffix_arrays(symbols, ends - sizes, ends)
    # A window must end within its segment: look ahead to the next mark.
    marks = np.flatnonzero(symbols < 2)
    room = marks[np.searchsorted(marks, np.arange(len(symbols)))] - np.arange(len(symbols)) >= window
    fits = room[order]
    near = np.flatnonzero(fits[1:] & fits[:-1])
    a, b = order[near], order[near + 1]
    line = np.concatenate([symbols, np.zeros(8, np.int32)]).astype(np.uint64)
    words = np.zeros(len(symbols), np.uint64)
    for k in range(4):
        words |= line[k : k + len(symbols)] << np.uint64(16 * k)
    for shift in [*range(0, window - 3, 4), window - 4]:
        same = words[a + shift] == words[b + shift]
        a, b = a[same], b[same]
    again = np.zeros(len(symbols), bool)
    again[a] = again[b] = True
    found, at = [], 0
    for group in groups:
        found.append([])
        for segment in group:
            found[-1].append(np.flatnonzero(again[at : at + len(segment)]))
            at += len(segment) + 1
        at += 1
    return found


def _compared(window: int):
    """Rows ordered by class and group: the repeated runs of each group's segments."""

    def flush(groups: list[list[tuple[int, int, int, bytes]]]) -> pa.RecordBatch:
        rows: list[list[int]] = [[], [], [], []]
        for group, found in zip(groups, repeated_starts([[s[3] for s in g] for g in groups], window)):
            for (f, dg, copies, _), starts in zip(group, found):
                if len(starts) and copies == 1:  # of several copies all windows are repeated anyway
                    first, last = runs_of(starts)
                    for column, values in zip(rows, ([f] * len(first), [dg] * len(first), first, last)):
                        column.extend(values)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["f", "dg", "a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple[int, int, int, bytes]]] = []
        size, last = 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("class", "f", "dg", "copies", "piece"))
            for kind, f, dg, copies, piece in zip(*columns):
                if (kind, f) != last:
                    if groups and (size >= BUNDLE or kind != last[0]):
                        yield flush(groups)
                        groups, size = [], 0
                    groups.append([])
                    last = (kind, f)
                groups[-1].append((f, dg, copies, piece))
                size += len(piece)
        if groups:
            yield flush(groups)

    return compared


def _small_groups(pieces: DataFrame, groups: DataFrame, window: int, crowd: int) -> DataFrame:
    """Repeated runs by suffix arrays. Groups of like size go to the same tasks."""
    kind = F.ceil(F.log2("different")).cast("int")
    # A row for each power of two up to `crowd`.
    totals = groups.where(F.col("different").between(2, crowd)).groupBy(kind.alias("class")).agg(F.sum("bytes").alias("b")).collect()
    lots = {row["class"]: max(1, -(-row.b // BUNDLE)) for row in totals}
    if not lots:
        return pieces.sparkSession.createDataFrame([], RUNS)
    by_kind = F.create_map(*[F.lit(x) for pair in lots.items() for x in pair])
    dealt = (
        pieces.where(F.col("different") <= crowd)
        .withColumn("class", kind)
        .withColumn("lot", F.pmod(F.xxhash64("f"), by_kind[F.col("class")]))
        .repartition(sum(lots.values()), "class", "lot")
        .sortWithinPartitions("class", "f")
    )
    return dealt.select("class", "f", "dg", "copies", "piece").mapInArrow(_compared(window), RUNS)


def _crowded_groups(pieces: DataFrame, window: int, crowd: int) -> DataFrame:
    """Repeated runs by digests of whole windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for f, dg, copies, piece in zip(*(part.column(c).to_pylist() for c in ("f", "dg", "copies", "piece"))):
                n = len(piece) - window + 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "digest": pa.array([xxhash.xxh3_128_digest(piece[k : k + window]) for k in range(n)], pa.binary()),
                        "f": [f] * n, "dg": [dg] * n, "single": [copies == 1] * n, "at": pa.array(range(n), pa.int32()),
                    }
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for f, dg, starts in zip(*(part.column(c).to_pylist() for c in ("f", "dg", "starts"))):
                first, last = runs_of(np.unique(np.array(starts, np.int32)))
                yield pa.RecordBatch.from_pydict({"f": [f] * len(first), "dg": [dg] * len(first), "a": first, "b": last})

    crowded = pieces.where(F.col("different") > crowd).select("f", "dg", "copies", "piece")
    windows = stage(crowded.mapInArrow(cut, "digest binary, f bigint, dg bigint, single boolean, at int"), "windows")
    again = stage(windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "again")
    hits = windows.where("single").join(again, "digest", "left_semi")
    return hits.groupBy("f", "dg").agg(F.collect_list("at").alias("starts")).mapInArrow(joined, RUNS)


def suffix_dedup(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = 16, filter_bytes: int = MOST_BYTES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) for each row."""
    spark, source = docs.sparkSession, texts(docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            found = anchors_of([t or b"" for t in part.column(1).to_pylist()], window, gram)[1]
            if len(found):
                yield pa.RecordBatch.from_pydict({"h": at_most_twice(found)})

    seen = spark.sparkContext.broadcast(seen_twice(source.mapInArrow(hashed, "h bigint"), filter_bytes))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = [t or b"" for t in part.column(1).to_pylist()]
            ids = np.array([NO_ID if d is None else d for d in part.column(0).to_pylist()], np.int64)
            text, hashes, first, last = anchors_of(values, window, gram)
            some = seen.value.holds(hashes)
            text, begin, size = text[some], first[some], (last - first)[some] + window
            digests = [
                xxhash.xxh3_64_intdigest(values[k][a : a + s]) for k, a, s in zip(text.tolist(), begin.tolist(), size.tolist())
            ]
            marks = {k: xxhash.xxh3_128_digest(values[k]) for k in set(text.tolist())}
            rows = hashes[some], np.array(digests, np.uint64).view(np.int64), ids[text], [marks[k] for k in text.tolist()], begin, size
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["f", "dg", "doc", "mark", "start", "size"])

    suspects = stage(source.mapInArrow(suspected, "f bigint, dg bigint, doc bigint, mark binary, start bigint, size int"), "suspects")
    held = F.min(F.struct("mark", "doc", "start", "size")).alias("held")
    segments = stage(suspects.groupBy("f", "dg").agg(F.count("*").alias("copies"), held), "segments")
    groups = segments.groupBy("f").agg(
        F.count("*").alias("different"), F.sum("copies").alias("all"), F.sum("held.size").alias("bytes")
    )
    groups = stage(groups.where(F.col("all") > 1).drop("all"), "groups")
    alive = stage(segments.join(groups.drop("bytes"), "f").select("f", "dg", "copies", "different", "held.*"), "alive")

    wanted = (
        alive.where("different > 1")
        .groupBy("mark", "doc")
        .agg(F.collect_list(F.struct("f", "dg", "copies", "different", "start", "size")).alias("wanted"))
    )

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = [t or b"" for t in part.column(1).to_pylist()]
            ids = [NO_ID if d is None else d for d in part.column(0).to_pylist()]
            marks = [xxhash.xxh3_128_digest(t) for t in values]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(values, pa.binary())],
                ["doc_id", "doc", "mark", "text"],
            )

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows: dict[str, list] = {c: [] for c in ("f", "dg", "copies", "different", "piece")}
            for text, lot in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                for w in lot:
                    for c in ("f", "dg", "copies", "different"):
                        rows[c].append(w[c])
                    rows["piece"].append(text[w["start"] : w["start"] + w["size"]])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))

    read = source.mapInArrow(marked, "doc_id bigint, doc bigint, mark binary, text binary")
    fetched = read.join(wanted, ["mark", "doc"]).select("text", "wanted")
    kinds = "f bigint, dg bigint, copies bigint, different bigint, piece binary"
    # Rows equal in doc_id and text fetch the same pieces; those have copies, so nothing rests on them.
    pieces = stage(fetched.mapInArrow(pieces_of, kinds), "pieces")

    whole = alive.where("copies > 1").selectExpr("f", "dg", "0 as a", f"size - {window} as b")
    runs = whole.unionByName(_small_groups(pieces, groups, window, crowd)).unionByName(_crowded_groups(pieces, window, crowd))
    runs = stage(runs, "runs")
    spans = (
        suspects.select("mark", "f", "dg", "start").distinct()
        .join(runs, ["f", "dg"])
        .groupBy("mark")
        .agg(F.collect_list(F.struct((F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") + window).alias("e"))).alias("spans"))
    )

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, lot in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                gone = np.zeros(len(text) + 1, np.int32)
                for span in lot or ():
                    gone[span["s"]] += 1
                    gone[span["e"]] -= 1
                out = np.cumsum(gone)[:-1] > 0
                n_bytes.append(len(text))
                n_removed.append(int(out.sum()))
                n_spans.append(int((np.diff(out.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~out].tobytes() if lot else text)
            columns = [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)], pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return read.join(spans, "mark", "left").select("doc_id", "text", "spans").mapInArrow(finished, out)
