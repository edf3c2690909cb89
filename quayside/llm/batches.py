"""Arrow batches in slices of bounded text, so that a worker holds few Python strings at once, and keeps none after its task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text to a slice; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000
#: Where the C library has it: gives freed pages back.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        start, seen = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, seen + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start, seen = stop, int(ends[stop - 1])


def give_back() -> None:
    """Return freed memory to the system; both allocators would keep it for later."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its worker holds no freed memory: workers wait for other tasks while the JVM beside them grows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def words_in(text: bytes, table: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about size bytes; table maps each byte to itself, to another or to a space."""
    text, at = text.translate(table), 0
    while len(text) - at > size:
        cut = text.rfind(b" ", at, at + size)
        cut = cut if cut > at else text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut].split()
        at = cut
    yield text[at:].split() if at else text.split()
