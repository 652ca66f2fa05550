"""Helpers for ``mapInArrow``: byte views of text columns, and complete key groups from a sorted stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(column: str = "text") -> Column:
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def slabs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 65_536) -> Iterator[pa.Table]:
    """Tables of whole key groups, about ``rows`` rows or one group each, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = n - 1
        same = np.ones(n, dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy(zero_copy_only=False)
            same &= column == column[last]
        at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if at:
            yield table.slice(0, at)
            held = table.slice(at).to_batches()
            n -= at
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def per_batch(make: Callable[[pa.RecordBatch], dict[str, object]], schema: pa.Schema):
    """A ``mapInArrow`` function that turns each batch into columns of ``schema``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)

    return run
