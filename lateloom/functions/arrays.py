"""Vectors between Arrow and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lateloom.params import DimMismatch


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of doubles, without a Python object for each number."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(vectors) and len(flat) % len(vectors) or vectors.null_count:
        raise DimMismatch("vectors differ in length")
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """As vectors.rounded_by_product: halves of the product go away from zero, where np.round takes them to the even digit."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.asarray(x, np.float64) * 10.0**digits
        whole = np.trunc(scaled)
        whole += np.copysign(np.abs(scaled - whole) >= 0.5, scaled)
        return np.where(np.isfinite(scaled), whole / 10.0**digits, x) + 0.0


def lists(rows: np.ndarray) -> pa.Array:
    """The other way round: rows of a matrix as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(rows).ravel()))
