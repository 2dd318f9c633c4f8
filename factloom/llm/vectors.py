"""Vectors of a table as matrices, with what a row must have to take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def whole(vector: str) -> Column:
    """True where the vector isn't null and all of its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of `size` finite components as rows of doubles, and the places in the column that they come from."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    flat = pc.list_flatten(column.take(pa.array(at)))
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    good = np.isfinite(rows).all(axis=1)
    return rows[good], at[good]
