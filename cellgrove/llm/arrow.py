"""mapInArrow over the text of documents, a few MB at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from cellgrove.llm.words import slices, text_buffer


def release() -> None:
    """Give free memory back to the system: a worker that waits for its next task counts with all that it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_slices(f: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None], text: str = "text", most: int = 2 << 20, last: Callable[[], None] | None = None):
    """A function for mapInArrow that calls f(rows, bytes, offsets) for runs of rows of about `most` bytes of text, and last() when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
            for a, b in slices(offs, most):
                out = f(batch.slice(a, b - a), buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if out is not None and out.num_rows:
                    yield out
        if last:
            last()
        release()

    return run


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from one flat array and the offsets of its rows."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))
