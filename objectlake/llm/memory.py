"""Python workers outlive their tasks; what a task has used goes back to the machine, for the JVM and the next task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim; elsewhere nothing is done."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


#: What operators remember from task to task in a worker, by name, and how to forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def release(keep: str = "") -> None:
    """Give back what is free, and forget what other operators have remembered in this worker."""
    for name, forget in REMEMBERED.items():
        if name != keep:
            forget()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(batches: Iterator[pa.RecordBatch], keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches; memory is released when they end, but for what is remembered under keep."""
    yield from batches
    release(keep)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts in a column take about so many bytes at most; a longer text is a slice of its own."""
    for b in batches:
        start = n = 0
        for k, size in enumerate(pa.compute.binary_length(b.column(column)).fill_null(0).to_pylist()):
            if n and n + size > most:
                yield b.slice(start, k - start)
                start, n = k, 0
            n += size
        if b.num_rows > start:
            yield b.slice(start)
