"""Arrow batches cut by bytes, so that a task turns only a few MB of text into Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def cuts(texts: pa.Array, most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, stop) of the slices of a column of strings or binaries: most bytes and rows at most, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        stop = max(start + 1, stop if rows is None else min(stop, start + rows))
        yield start, stop
        start = stop


def sliced(batches: Iterator[pa.RecordBatch], column: int | str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in cuts(batch.column(column), most):
            yield batch.slice(start, stop - start)
