"""Arrow batches in lots: what Python makes of texts is many times their size, so it is made of a few at a time."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text in a lot; a longer text is a lot of its own.
LOT_ROWS, LOT_BYTES = 256, 1 << 18


def text_lots(sizes: np.ndarray, rows: int = LOT_ROWS, most: int = LOT_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of successive lots of texts of these sizes."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        stop = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield first, stop
        first = stop


def text_sizes(*columns: pa.Array) -> np.ndarray:
    """Bytes of each row's texts."""
    return sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)


def lots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in lots by the size of their text columns; freed memory goes back to the system when they end."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        for first, stop in text_lots(np.zeros(batch.num_rows, np.int64) + text_sizes(*texts)):
            yield batch.slice(first, stop - first)
    release()


def release() -> None:
    """Give freed memory back to the system: a worker is kept for further tasks, and idle ones would hold on to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)
