"""Vectors as whole-number matrices: which rows count, and Arrow lists as numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector_col: str) -> Column:
    """The vector is there and every component is a finite number."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector_col).isNotNull() & fine


def matrix(lists: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x), x as double, one row a list; shorter lists end in zeros, longer ones are cut at dims."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64))
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), dims))
    out[row[col < dims], col[col < dims]] = flat[col < dims]
    return out
