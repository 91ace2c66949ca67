"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level k holds chunk k of every id that has one,
a bitmap that says which of them continue on level k + 1, and a rank directory: the number of ones
before each 512 bits. The chunk of id i on the next level lies at the rank of i, so any id, or any
document's run of ids, is read without decoding what lies before it.

Files are Parquet: one row for each block, in ascending doc_id order, with the block's doc_ids,
where each document begins, and the levels. A block ends with the document that brings it to
`block_ids` ids, so a block holds at most one document more than that. Blocks are named by (shard,
block); a shard is what one write task wrote.

Words are looked up in a memory of encoded words, bounded in bytes, that later tasks of a worker go on with. ASCII white space parts words, and ASCII
marks that close a word are parted from a letter or digit before them; both always part tokens in
this tokenizer, so the ids are those of the whole text.

Defined cases: a null or empty text has only the end id. Rows with one doc_id are written side by
side, in the order of a hash of their texts; a null doc_id comes first. Other columns are ignored. An empty
table gives files without rows and an empty result.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from longspan.llm.batches import slices, texts
from longspan.sources.stages import load_table, save_table

SAMPLE_BITS = 512
#: Bytes of words and their ids kept in each of two generations, counted with what Python adds.
#: A pipeline's workers have other stages behind and before them, and keep fewer.
KNOWN_BYTES, FEW_KNOWN_BYTES = 44 << 20, 12 << 20
CLOSING = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LEVEL = "struct<chunks: binary, more: binary, ranks: binary>"
BLOCK = f"shard int, block int, first bigint, doc_ids array<bigint>, starts array<bigint>, levels array<{LEVEL}>"
_encoders: dict[str, "Encoder"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for
    itself, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes texts word by word, keeping what it has met lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def keep(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.size += 180 + len(word) + len(ids)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def parts(self, word: bytes) -> tuple[bytes, ...]:
        """A word without its closing ASCII marks, and the marks, if a letter or digit parts them."""
        base = word.rstrip(CLOSING)
        if base and base != word and base.decode("utf-8", "replace").lower()[-1].isalnum():
            return base, word[len(base) :]
        return (word,)

    def learn(self, words: set[bytes]) -> None:
        parted = {}
        for word in words:
            if (ids := self.older.get(word)) is not None:
                self.keep(word, ids)
            else:
                parted[word] = self.parts(word)
        rest = []
        for part in {p for parts in parted.values() for p in parts}:
            if part in self.known:
                continue
            if part in self.older:
                self.keep(part, self.older[part])
                continue
            text = part.decode("utf-8", "replace")
            # Lower-case Latin letters in composed form are one token run, which the model takes as it is.
            if text.isalpha() and text.islower() and max(text) < "\u0250":
                tokens = self.model.tokenize(text if part.isascii() else "".join(self.letters[b] for b in part))
                self.keep(part, array("I", [t.id for t in tokens]).tobytes())
            else:
                rest.append(part)
        if rest:
            for part, ids in zip(rest, self.whole([p.decode("utf-8", "replace") for p in rest])):
                self.keep(part, ids)
        for word, parts in parted.items():
            if len(parts) > 1:
                self.keep(word, b"".join(self.known[p] for p in parts))

    def encode(self, values: pa.Array, known_bytes: int = KNOWN_BYTES) -> list[np.ndarray]:
        """Ids of each text of a binary array."""
        if self.size > known_bytes:
            self.known, self.older, self.size = {}, self.known, 0
        # A text that may hold the tokenizer's own marks is encoded whole.
        raw = pc.fill_null(pc.match_substring(values, b"<|"), False)
        plain = pc.if_else(raw, pa.scalar(b"", pa.binary()), pc.fill_null(values, b""))
        lots = pc.ascii_split_whitespace(pc.ascii_lower(plain.cast(pa.string(), safe=False)))
        words = lots.flatten().cast(pa.binary()).dictionary_encode()
        distinct, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
        if new := {w for w in distinct if w not in self.known}:
            self.learn(new)
        held = [self.known[w] for w in distinct]
        sizes = np.array([len(h) // 4 for h in held], np.int64)
        ends = np.cumsum(sizes)
        each = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        places = np.repeat((ends - sizes)[codes] - upto[:-1], each) + np.arange(upto[-1])
        ids = np.frombuffer(b"".join(held), "<u4")[places]
        bounds = upto[lots.offsets.to_numpy() - lots.offsets[0].as_py()]
        found = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for k in np.flatnonzero(raw.to_numpy(zero_copy_only=False)):
            found[k] = np.frombuffer(self.whole([values[int(k)].as_py().decode("utf-8", "replace")])[0], "<u4")
        return found


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def levels_of(ids: np.ndarray) -> list[dict[str, bytes]]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        ones = np.add.reduceat(more, np.arange(0, len(more), SAMPLE_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        levels.append(
            {
                "chunks": (rest & 255).astype(np.uint8).tobytes(),
                "more": np.packbits(more).tobytes(),
                "ranks": ranks.astype("<u4").tobytes(),
            }
        )
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def rank(level: dict[str, bytes], place: int) -> int:
    """Ones before a place of the bitmap."""
    sample = place // SAMPLE_BITS
    ranks = np.frombuffer(level["ranks"], "<u4")
    if sample >= len(ranks):
        sample = len(ranks) - 1
    begin = sample * SAMPLE_BITS
    bits = np.frombuffer(level["more"], np.uint8, offset=begin // 8, count=min(len(level["more"]) - begin // 8, -(-(place - begin) // 8)))
    return int(ranks[sample]) + int(np.unpackbits(bits)[: place - begin].sum())


def ids_at(levels: list[dict[str, bytes]], begin: int, end: int) -> np.ndarray:
    """Ids begin to end (exclusive), from those places of each level only."""
    if begin >= end:
        return np.zeros(0, np.uint32)
    level = levels[0]
    ids = np.frombuffer(level["chunks"], np.uint8, offset=begin, count=end - begin).astype(np.uint32)
    if len(levels) > 1:
        low = begin // 8
        bits = np.frombuffer(level["more"], np.uint8, offset=low, count=-(-end // 8) - low)
        more = np.unpackbits(bits)[begin - 8 * low : end - 8 * low].astype(bool)
        if n := int(more.sum()):
            at = rank(level, begin)
            ids[more] |= ids_at(levels[1:], at, at + n) << np.uint32(8)
    return ids


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 18,
    known_bytes: int = KNOWN_BYTES, keep_known: bool = True,
) -> None:
    """Encode every text, append the end id, and write blocks in ascending doc_id order.

    A worker keeps two generations of about `known_bytes` of words, and drops them with each task
    unless `keep_known`; neither changes any id.
    """
    end = np.array([end_id], np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        starts: list[int] = []
        block = first = size = 0

        def row() -> pa.RecordBatch:
            levels = levels_of(np.concatenate(held))
            values = {"shard": [shard], "block": [block], "first": [first], "doc_ids": [doc_ids], "starts": [starts], "levels": [levels]}
            kinds = pa.schema(
                [
                    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
                    ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))),
                ]
            )
            return pa.RecordBatch.from_pydict(values, kinds)

        for part in slices(batches, 512):
            for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1), known_bytes)):
                doc_ids.append(doc)
                starts.append(size)
                held += (ids, end)
                size += len(ids) + 1
                if size >= block_ids:
                    yield row()
                    held, doc_ids, starts = [], [], []
                    block, first, size = block + 1, first + size, 0
        if doc_ids:
            yield row()
        if not keep_known:
            words.forget()

    # The hash of the text spreads one doc_id's rows over tasks; whole texts would be sampled otherwise.
    place = ["doc_id", F.xxhash64("text")]
    ordered = texts(docs).repartitionByRange(*place).sortWithinPartitions(*place, "text")
    save_table(ordered.mapInArrow(blocks, BLOCK), path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32-bit,
    little-endian) of each document in the files."""
    stored = load_table(spark, path)
    size = F.length(F.col("levels")[0]["chunks"]).cast("bigint")
    # One row for each write task.
    shards = stored.groupBy("shard").agg(F.max(F.col("first") + size).alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            levels, starts = row["levels"], row["starts"]
            ends = [*starts[1:], len(levels[0]["chunks"])]
            shift = row["base"] + row["first"]
            for k in range(0, len(starts), 4096):
                lot = slice(k, k + 4096)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"][lot], pa.int64()),
                        "start": [shift + s for s in starts[lot]],
                        "n_tokens": [b - a for a, b in zip(starts[lot], ends[lot])],
                        "ids": [ids_at(levels, a, b).astype("<u4").tobytes() for a, b in zip(starts[lot], ends[lot])],
                    }
                )

    return stored.join(F.broadcast(bases), "shard").select("base", "first", "doc_ids", "starts", "levels").mapInArrow(
        documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )
