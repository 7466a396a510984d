"""Dense vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def unpack(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): indices of the usable vectors of an array column and the vectors as float32.

    Usable: exactly ``dim`` numbers, none of them null, NaN or infinite, not all zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    offsets = column.offsets.to_numpy()
    right = (np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(right)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # nulls become NaN
    x = flat[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim), np.float32)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], np.ascontiguousarray(x[good])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def to_blob(x: np.ndarray) -> bytes:
    """V1: little-endian float32 bytes; only finite numbers."""
    x = np.asarray(x, "<f4")
    if not np.isfinite(x).all():
        raise ValueError("a vector holds only finite numbers")
    return x.tobytes()


def from_blob(data: bytes) -> np.ndarray:
    """V1: the vector of such bytes; their number is a multiple of four."""
    if len(data) % 4:
        raise ValueError("the length is no multiple of four")
    return np.frombuffer(data, "<f4")
