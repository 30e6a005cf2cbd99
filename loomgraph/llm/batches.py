"""Arrow batches in slices, so that a worker holds few texts as Python strings and hands back small batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows of a slice.
SLICE_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, in order, in batches of at most ``rows``; empty batches give none."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
