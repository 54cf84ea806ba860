"""Arrow list columns as matrices, and back, without a Python object for each number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have dim components without nulls, and their values."""
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    if not column.null_count and (sizes == dim).all() and not column.flatten().null_count:
        return np.ones(len(column), bool), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    rows = column.to_pylist()
    good = np.array([v is not None and len(v) == dim and None not in v for v in rows], bool)
    return good, np.array([v for v, g in zip(rows, good) if g], np.float64).reshape(-1, dim)


def lists(values: np.ndarray, good: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with the rows of values where good, and nulls elsewhere."""
    offsets = np.concatenate([[0], np.cumsum(good * (values.shape[1] if values.ndim == 2 else 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind), mask=pa.array(~good))
