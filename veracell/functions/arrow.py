"""Arrow batches as NumPy matrices inside tasks."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column) -> np.ndarray:
    """An array<double> column of equal lengths as a rows x positions matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def arrays(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array<double> column."""
    n, d = m.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


#: Bytes of text that are worked on at once.
SLAB = 1 << 21


def text_slabs(column: pa.Array) -> Iterator[pa.Array]:
    """A text column in parts of about ``SLAB`` bytes; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + SLAB, "right")))
        yield column.slice(lo, hi - lo)
        lo = hi
