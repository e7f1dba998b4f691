"""Expressions over ``ARRAY<DOUBLE>`` feature vectors.

Small matrices are unrolled into plain column arithmetic, which stays in
generated JVM code; larger ones go through an Arrow UDF with one NumPy matrix
product per batch.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Above this many matrix entries the unrolled expression outgrows generated code.
MAX_UNROLLED_ENTRIES = 256


def to_matrix(values: pa.Array) -> np.ndarray:
    """(n, d) view of an Arrow list column whose lists all have d doubles."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if len(values) == 0:
        return np.empty((0, 0))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(values), -1)


def to_lists(matrix: np.ndarray) -> pa.Array:
    """Arrow list column with one list per matrix row."""
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def feature_array(columns) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def _weighted_sum(items: list[tuple[Column, float]]) -> Column:
    terms = [column * F.lit(float(weight)) for column, weight in items if weight != 0.0]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def matmul(vector: Column, matrix: np.ndarray) -> Column:
    """Row vector times ``matrix`` (d x m), as ``ARRAY<DOUBLE>`` of length m."""
    matrix = np.asarray(matrix, dtype=np.float64)
    d, m = matrix.shape
    if m == 0:
        return F.array().cast("array<double>")
    if d * m <= MAX_UNROLLED_ENTRIES:
        cells = [F.get(vector, F.lit(i)) for i in range(d)]
        return F.array(
            *[_weighted_sum([(cells[i], matrix[i, j]) for i in range(d)]) for j in range(m)]
        )

    @F.arrow_udf("array<double>")
    def product(batch: pa.Array) -> pa.Array:
        rows = to_matrix(batch)
        return to_lists(rows @ matrix if len(rows) else np.empty((0, m)))

    return product(vector)


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x)


def norm(vector: Column) -> Column:
    return F.sqrt(squared_norm(vector))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a - b)


def l2_normalize(vector: Column, tiny: float = 1e-10) -> Column:
    """Unit vector, or the zero vector when the norm is not above ``tiny``."""
    length = norm(vector)
    return F.when(length > tiny, F.transform(vector, lambda x: x / length)).otherwise(
        F.transform(vector, lambda x: x * 0.0)
    )


def project_onto_subspace(vector: Column, basis_rows: np.ndarray) -> Column:
    """Orthogonal projection onto the span of orthonormal ``basis_rows``."""
    rows = np.atleast_2d(np.asarray(basis_rows, dtype=np.float64))
    return matmul(vector, rows.T @ rows)


def tangent_projection(vector: Column, basis: np.ndarray) -> Column:
    """Part of ``vector`` in the column span of ``basis`` (d x q)."""
    return project_onto_subspace(vector, np.asarray(basis, dtype=np.float64).T)


def normal_projection(vector: Column, basis: np.ndarray) -> Column:
    """Part of ``vector`` orthogonal to the columns of ``basis``."""
    basis = np.asarray(basis, dtype=np.float64)
    d, q = basis.shape
    if q >= d:
        return F.transform(vector, lambda x: x * 0.0)
    return matmul(vector, np.eye(d) - basis @ basis.T)
