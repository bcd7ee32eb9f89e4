"""Vectors of Arrow batches as exact integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 1 << 27     # components stay below this, so that sums of 64 squared differences fit 63 bits


def dense(col: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of a list<double> column.

    Returns (flags of the usable rows, their lengths, their components one row after
    the other). A row is usable if neither it nor a component is null or non-finite."""
    n = len(col)
    size = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = col.flatten()
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(n), size)
    finite = np.isfinite(x)
    ok = ~np.asarray(col.is_null()) & (np.bincount(row[~finite], minlength=n) == 0)
    x = np.floor(scale * x[ok[row]])
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a vector has a component of {np.abs(x).max() / scale:g}; the largest allowed is {LIMIT // scale}")
    return ok, size[ok], x.astype(np.int64)


def binary(rows: np.ndarray) -> pa.Array:
    """Each row of a C-contiguous matrix as its bytes."""
    rows = np.ascontiguousarray(rows)
    step = rows.dtype.itemsize * (rows.shape[1] if rows.ndim == 2 else 1)
    off = (np.arange(len(rows) + 1) * step).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(rows.tobytes())])
