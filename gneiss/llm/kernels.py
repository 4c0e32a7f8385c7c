"""Functions that run inside tasks, on Arrow data."""

from __future__ import annotations

import pyarrow as pa


def slices(batch: pa.RecordBatch | pa.Array, rows: int = 512):
    """Parts of a batch or column, so that a task holds Python objects for a few rows only."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
