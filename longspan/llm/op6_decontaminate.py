"""Benchmark decontamination: windows of benchmark words that occur in documents.

A window is `window` consecutive words of an item; a shorter item with any word is one window. A
document word inside an occurrence of a window is hit.

A prefix-filtered set join. A window occurs only if all its word shingles do, so by the prefix
principle one token is enough to find it: its rarest shingle, by counts over all documents. That
shingle's place in a document fixes where the window would begin and end, which must lie within
the document, and there the words are compared.

The benchmark is taken in blocks of about `block_windows` windows, so what is broadcast does not
grow with it; each block is held against all documents. Documents are never shuffled for one block;
with more blocks the hits are brought together by document.

Defined cases: a null text has no words, and an item without words has no window. Items that share
an id are one item; a null item_id hits words but is not listed. Rows with one doc_id each give a
row. Other columns are ignored. An empty benchmark hits nothing; no documents give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from longspan.llm.batches import slices, texts

#: A-Z become a-z, other ASCII characters but digits and a-z part words.
FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
PIECE = 4096
RESULT = "doc_id bigint, mark binary, n_words bigint, n_hit bigint, hits array<int>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


@dataclass
class Block:
    """Windows of some items, and where their tokens are found."""

    window: int
    shingle: int
    words: dict[bytes, int] = field(default_factory=dict)
    items: dict[tuple[int, ...], set[str | None]] = field(default_factory=lambda: defaultdict(set))
    #: By shingle length: the sorted codes of all shingles.
    codes: dict[int, np.ndarray] = field(default_factory=dict)
    #: By shingle length: codes of the windows' rarest shingles, and the windows of each.
    prefixes: dict[int, tuple[np.ndarray, list[list[tuple[int, int, bytes, list[str]]]]]] = field(default_factory=dict)

    def add(self, item: str | None, piece: list[bytes]) -> None:
        ids = tuple(self.words.setdefault(w, len(self.words)) for w in piece)
        for start in range(max(1, len(ids) - self.window + 1)):
            self.items[ids[start : start + self.window]].add(item)

    def width(self, size: int) -> int:
        return min(self.shingle, size)

    def code(self, ids: np.ndarray, width: int) -> np.ndarray:
        """Codes of all shingles of a text; -1 where a word is none of the block's."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(width):
            code = code * (len(self.words) + 1) + ids[k : k + n]
            known &= ids[k : k + n] >= 0
        return np.where(known, code, -1)

    def seal(self) -> None:
        found = defaultdict(list)
        for ids in self.items:
            width = self.width(len(ids))
            found[width].append(self.code(np.array(ids, np.int64), width))
        self.codes = {w: np.unique(np.concatenate(lots)) for w, lots in found.items()}

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle."""
        chosen: dict[int, dict[int, list]] = {w: defaultdict(list) for w in self.codes}
        for ids, items in self.items.items():
            width = self.width(len(ids))
            row = self.code(np.array(ids, np.int64), width)
            rarity = counts[width][np.searchsorted(self.codes[width], row)]
            at = int(np.argmin(rarity))
            chosen[width][int(row[at])].append((at, len(ids), np.array(ids, np.int32).tobytes(), sorted(i for i in items if i is not None)))
        self.prefixes = {}
        for width, lots in chosen.items():
            keys = np.array(sorted(lots), np.int64)
            self.prefixes[width] = keys, [lots[int(k)] for k in keys]

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, -1) for w in words], np.int64)

    def match(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Mask of hit words, and the items that hit them."""
        hit, items = np.zeros(len(ids), bool), set()
        packed = ids.astype(np.int32).tobytes()
        for width, (keys, windows) in self.prefixes.items():
            row = self.code(ids, width)
            at = np.searchsorted(keys, row)
            at[at == len(keys)] = 0
            for place in np.flatnonzero(keys[at] == row):
                for offset, size, words, names in windows[at[place]]:
                    start = int(place) - offset
                    if start >= 0 and start + size <= len(ids) and packed[4 * start : 4 * (start + size)] == words:
                        hit[start : start + size] = True
                        items.update(names)
        return hit, items


def runs(hit: np.ndarray) -> np.ndarray:
    """Begin and end of each run of True, in one flat list."""
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))


def _pieces(items: DataFrame, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, pieces = [], []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = words_of(text)
                for k in range(0, max(1, len(words) - window + 1), PIECE):
                    if words:
                        ids.append(item)
                        pieces.append(b" ".join(words[k : k + PIECE + window - 1]))
            yield pa.RecordBatch.from_pydict({"item": pa.array(ids, pa.string()), "piece": pa.array(pieces, pa.binary())})

    source = items.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    return source.mapInArrow(cut, "item string, piece binary")


def _blocks(items: DataFrame, window: int, shingle: int, block_windows: int) -> Iterator[Block]:
    pieces = _pieces(items, window)
    size = F.greatest(F.size(F.split(F.col("piece").cast("string"), " ")) - (window - 1), F.lit(1))
    total = pieces.agg(F.sum(size)).first()[0] or 0
    n = -(-total // block_windows)
    for k in range(n):
        block = Block(window, shingle)
        lot = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(n)) == k) if n > 1 else pieces
        for row in lot.toLocalIterator():
            block.add(row.item, bytes(row.piece).split())
        block.seal()
        if block.items:
            yield block


def _counted(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        sums = {w: np.zeros(len(c), np.int64) for w, c in block.codes.items()}
        for part in slices(batches):
            for text in part.column(1).to_pylist():
                ids = block.ids(words_of(text))
                for width, codes in block.codes.items():
                    row = block.code(ids, width)
                    row = row[row >= 0]
                    at = np.searchsorted(codes, row)
                    at[at == len(codes)] = 0
                    np.add.at(sums[width], at[codes[at] == row], 1)
        for width, lot in sums.items():
            some = np.flatnonzero(lot)
            yield pa.RecordBatch.from_pydict({"width": pa.array([width] * len(some), pa.int32()), "at": some, "n": lot[some]})

    rows = docs.mapInArrow(count, "width int, at bigint, n bigint").groupBy("width", "at").agg(F.sum("n").alias("n"))
    counts = {w: np.zeros(len(c), np.int64) for w, c in block.codes.items()}
    for row in rows.toLocalIterator():
        counts[row.width][row["at"]] = row.n
    return counts


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, block_windows: int = 200_000
) -> DataFrame:
    """doc_id, n_words, hits (begin and end of each run of hit words, flat), n_hit, items (sorted
    ids of items that occur) and contaminated, for each row."""
    source, found = texts(docs), []
    for block in _blocks(items, window, shingle, block_windows):
        block.order(_counted(source, block))
        found.append(source.mapInArrow(_matcher(source, block), RESULT))
    if not found:
        found = [source.mapInArrow(_matcher(source, Block(window, shingle)), RESULT)]
    result = found[0]
    if len(found) > 1:
        for more in found[1:]:
            result = result.unionByName(more)
        result = _together(result, len(found))
    return result.select(
        "doc_id", "n_words", "hits", "n_hit", F.array_sort("items").alias("items"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_benchmark(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows, as they are, of documents that hold no window of the benchmark."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    found = decontaminate(docs, items, window).where("contaminated").select(key.alias("key")).distinct()
    packed = docs.select(key.alias("key"), F.struct("*").alias("row"))
    return packed.join(found, "key", "left_anti").select("row.*")


def _matcher(docs: DataFrame, block: Block):
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for part in slices(batches):
            marks, n_words, n_hit, hits, items = [], [], [], [], []
            for text in part.column(1).to_pylist():
                words = words_of(text)
                hit, names = block.match(block.ids(words))
                marks.append(None if text is None else xxhash.xxh3_128_digest(text))
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                hits.append(runs(hit))
                items.append(sorted(names))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0), "mark": pa.array(marks, pa.binary()), "n_words": pa.array(n_words, pa.int64()),
                    "n_hit": pa.array(n_hit, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string())),
                }
            )

    return match


def _together(rows: DataFrame, blocks: int) -> DataFrame:
    """Unite the hits of each document over all blocks; equal rows come back as often as they were."""
    merged = rows.groupBy("doc_id", "mark", "n_words").agg(
        F.collect_set(F.when(F.size("hits") > 0, F.col("hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        (F.count("*") / blocks).cast("int").alias("n"),
    )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hits, n_hit = [], []
            for n, lots in zip(part.column("n_words").to_pylist(), part.column("hits").to_pylist()):
                hit = np.zeros(n, bool)
                for lot in lots:
                    for a, b in zip(lot[::2], lot[1::2]):
                        hit[a:b] = True
                n_hit.append(int(hit.sum()))
                hits.append(runs(hit))
            columns = {c: part.column(c) for c in ("doc_id", "mark", "n_words")}
            yield pa.RecordBatch.from_pydict({**columns, "n_hit": pa.array(n_hit, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "items": part.column("items")})

    repeated = merged.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")
    return repeated.mapInArrow(unite, RESULT)
