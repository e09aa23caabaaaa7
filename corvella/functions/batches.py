"""Arrow batches of bounded size: a batch has a number of rows, whatever their texts weigh."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts or files that are Python objects at once; one value may have more.
BATCH_BYTES = 1 << 20


def slices(values: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of values with about ``limit`` bytes each, a value whole; null has none."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, end - start
        start = end


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column of texts or files has about ``limit`` bytes in each."""
    for b in batches:
        for start, n in slices(b.column(column), limit):
            yield b.slice(start, n)
