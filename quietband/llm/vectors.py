"""Vectors of the training-data operators: which take part, and how tasks read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """Whether a vector is neither NULL nor zero and holds finite components only."""
    column = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(
        column.isNotNull() & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0), F.lit(False)
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists as the rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
