"""Bounded slices of Arrow batches for operators that run Python over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: A slice holds at most so many rows and, unless one text alone is longer, so many characters (by their bytes).
SLICE_ROWS, SLICE_BYTES = 2_000, 16_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of bounded size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and (held + size > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


import pyarrow.compute  # noqa: E402,F401  (registers pa.compute)
