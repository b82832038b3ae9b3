"""What the operators of this subpackage share: stored tables, and Arrow batches in slices."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa

from corvane.store import bounded_broadcast, drop, folder, stored

__all__ = ["bounded_broadcast", "drop", "folder", "release", "slices", "stored"]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches of mapInArrow() in slices of so many rows at most, so that what is made of them is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Give what a task has freed back to the system: Python workers wait for the next stage, and what they keep is missing there."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library has no such call
