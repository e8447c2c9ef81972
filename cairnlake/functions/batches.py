"""Cutting Arrow batches by the size of what they hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES = 8 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes of a column, or of one row; empty batches are left out."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(start, stop - start)
            start = stop
