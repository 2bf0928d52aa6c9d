"""Arrow batches in small slices, and memory given back when a task ends."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterable, Iterator

import pyarrow as pa

_libc = ctypes.CDLL(ctypes.util.find_library("c") or None)


def settle() -> None:
    """Gives memory that is free but held back to the system; workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``, so that no more texts than that are Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    settle()
