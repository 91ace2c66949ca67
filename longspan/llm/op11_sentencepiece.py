"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows, and every
normalised byte keeps its place in the source. Runs that begin with space marks are merged one by
one (no piece crosses their start), each distinct run once while it is remembered, and the pieces'
places are projected to byte spans of the original text. Decoding reads ids only.

Work goes by groups of texts of about a megabyte, and what a worker remembers is bounded in bytes,
so memory does not grow with the vocabulary of the corpus.

Defined cases: a null or empty text has only the end id, at span (0, 0), and decodes to an empty text.
The end id's span is empty and lies at the end. Bytes that are not UTF-8 count as U+FFFD. Equal rows
each give a row; a null doc_id stays null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from longspan.llm.batches import slices, texts
from longspan.llm.pieces import SPACE, PieceModel

#: Bytes of text handled at a time, and of remembered runs (with their pieces) in a task.
GROUP_BYTES, KNOWN_BYTES = 1 << 20, 48 << 20
RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Encoder:
    """Encodes texts run by run, with the pieces of the runs it knows in flat arrays."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.size = 0
        # By run: where its pieces begin, and its normalised bytes. By piece: id and span in the run.
        self.first, self.width = array("q", [0]), array("i")
        self.ids, self.begins, self.ends = array("i"), array("i"), array("i")

    def learn(self, runs: list[str]) -> None:
        *pieces, counts, widths = self.model.encoded(runs)
        for held, new in zip((self.ids, self.begins, self.ends, self.width), (*pieces, widths)):
            held.frombytes(new.astype(np.int32).tobytes())
        self.first.frombytes((self.first[-1] + np.cumsum(counts)).tobytes())
        self.places.update(zip(runs, range(len(self.places), len(self.places) + len(runs))))
        self.size += 180 * len(runs) + 2 * int(widths.sum()) + 12 * int(counts.sum())

    def runs(self, normalised: bytes) -> list[str]:
        text = normalised.decode()
        if not self.model.parts_at_spaces:
            return [text] if text else []
        return RUN.findall(text)

    def encode(self, values: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, begins and ends (bytes of the source) of each text, without an end id."""
        if self.size > KNOWN_BYTES:
            self.forget()
        each = []
        sources = []
        for value in values:
            normalised, source = self.model.normalised(value or b"")
            each.append(self.runs(normalised))
            sources.append(source)
        new = {r for runs in each for r in runs if r not in self.places}
        if new:
            self.learn(sorted(new, key=len))
        codes, counts = array("q"), [len(runs) for runs in each]
        for runs in each:
            codes.extend(map(self.places.__getitem__, runs))
        run = np.array(codes, np.int64)
        first, width = np.frombuffer(self.first, np.int64), np.frombuffer(self.width, np.int32) if self.width else np.zeros(0, np.int32)
        pieces = (first[1:] - first[:-1])[run]
        upto = np.concatenate([[0], np.cumsum(pieces)])
        at = np.repeat(first[run] - upto[:-1], pieces) + np.arange(upto[-1])
        # Where each run begins in its own normalised text.
        length = np.concatenate([[0], np.cumsum(width[run])])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        begin = length[:-1] - np.repeat(length[bounds[:-1]], counts)
        shift = np.repeat(begin, pieces)
        ids, begins, ends = (np.frombuffer(p, np.int32)[at] if p else np.zeros(0, np.int32) for p in (self.ids, self.begins, self.ends))
        begins, ends = begins + shift, ends + shift
        out = []
        for source, a, b in zip(sources, upto[bounds[:-1]], upto[bounds[1:]]):
            out.append((ids[a:b], source[begins[a:b]].astype(np.int32), source[ends[a:b]].astype(np.int32)))
        return out


@lru_cache(maxsize=2)
def read_model(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, which later tasks go on with."""
    return Encoder(read_model(path))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    """(other values, texts) of about GROUP_BYTES of text at a time."""
    for part in slices(batches):
        held, size = 0, 0
        lengths = [0 if v is None else len(v) for v in (s.as_buffer() if s.is_valid else None for s in part.column(1))]
        for k, length in enumerate(lengths):
            size += length
            if size >= GROUP_BYTES or k == part.num_rows - 1:
                lot = part.slice(held, k + 1 - held)
                yield lot.column(0).to_pylist(), lot.column(1).to_pylist()
                held, size = k + 1, 0


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (with the end id), begins and ends (byte spans in the text), spans_crc32 (of the
    two as little-endian 32-bit numbers, one after the other) and decoded, the text of the ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = read_model(model_path)
        encoder, end = encoder_of(model_path), np.array([model.end_id], np.int32)
        for keys, values in groups(batches):
            ids, begins, ends, checks, shown = [], [], [], [], []
            for value, (own, begin, stop) in zip(values, encoder.encode(values)):
                over = np.array([len(value or b"")], np.int32)
                ids.append(np.concatenate([own, end]))
                begins.append(np.concatenate([begin, over]))
                ends.append(np.concatenate([stop, over]))
                checks.append(zlib.crc32(ends[-1].astype("<i4").tobytes(), zlib.crc32(begins[-1].astype("<i4").tobytes())))
                shown.append(model.decoded(ids[-1].tolist()).decode())
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate(part)) for part in (ids, begins, ends)]
            columns = [pa.array(keys, pa.int64()), *lists, pa.array(checks, pa.int64()), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "begins", "ends", "spans_crc32", "decoded"])

    kinds = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, spans_crc32 bigint, decoded string"
    return texts(docs).mapInArrow(encoded, kinds)


def decode(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ids; a null list decodes to null."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = read_model(model_path)
        for part in slices(batches):
            shown = [None if own is None else model.decoded(own).decode() for own in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shown, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(ids).cast("array<int>")).mapInArrow(decoded, "doc_id bigint, text string")
