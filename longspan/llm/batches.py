"""Reading and writing Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows handled at a time, so that a task holds a few megabytes of texts as Python objects.
ROWS = 256


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null stays null), and other columns by name."""
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")]
    return docs.select(*columns, *[F.col(c) for c in more])


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    # A worker lives on after its task, and would hold on to the buffers of its largest batch.
    pa.default_memory_pool().release_unused()


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)
