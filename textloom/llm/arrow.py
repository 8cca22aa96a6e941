"""Small helpers for Arrow-batched workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def strings(column: pa.Array) -> list:
    """A string column as Python values, nulls as None."""
    return column.to_pylist()


def int_lists(parts: list[np.ndarray], kind: pa.DataType = pa.int32()) -> pa.ListArray:
    """One list per array, built without a Python integer per item."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    if parts:
        np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype()), kind))
