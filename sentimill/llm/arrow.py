"""Helpers for operators that walk texts inside ``mapInArrow`` tasks.

Batches arrive as Arrow and leave as Arrow, so 64-bit ids stay exact where nulls occur. A task holds
one batch, cut into slices of bounded text volume, and never a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task handles at a time, and at most one text more.
SLICE_BYTES = 1_000_000


def crc_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name``, with underscores put before it as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Zero-copy runs of rows with their texts (null: None), each of about ``limit`` bytes of text; only a run's texts are Python objects at a time."""
    for part in runs(batch, column, limit):
        yield part, part.column(column).to_pylist()


def raw_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """As ``slices``, with the texts' bytes (null: none)."""
    for part in runs(batch, column, limit):
        yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


def runs(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // limit  # rows by the bytes before them
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


def map_texts(df: DataFrame, text: str, schema: str, start: Callable[[], Callable]) -> DataFrame:
    """Rows of ``df`` with new columns that a per-task function gives for the texts.

    ``start()`` runs once in each task and returns ``f(texts) -> {column: arrow array}``. Columns of
    ``df`` other than ``text`` are carried; ``schema`` names the new ones.
    """
    carried = [f for f in df.schema.fields if f.name != text]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + [schema])
    names = [f.name for f in carried]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or start()
            for part, texts in slices(batch, text):
                new = f(texts)
                arrays = [part.column(n) for n in names] + list(new.values())
                yield pa.RecordBatch.from_arrays(arrays, names=names + list(new))

    return df.mapInArrow(task, out)
