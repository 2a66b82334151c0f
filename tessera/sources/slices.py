"""Arrow columns in slices, so that a task makes and holds no more than a few MB at once, whatever the size of Spark's batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a slice, about; one value at least.
SLICE = 1 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def cuts(column: pa.Array, size: int = SLICE) -> list[tuple[int, int]]:
    """The first and last place of slices of a column of strings or binaries; an empty one is a slice."""
    n = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    part = (np.cumsum(n) - n) // size
    at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(column)]
    return list(zip(at[:-1], at[1:], strict=True))


def slices(columns: Iterable[pa.Array], size: int = SLICE) -> Iterator[pa.Array]:
    """Columns of strings or binaries, each in slices of about so many bytes; an empty one as it is."""
    for column in columns:
        for i, j in cuts(column, size):
            yield column.slice(i, j - i)
        # workers wait for later tasks with what they hold
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)
