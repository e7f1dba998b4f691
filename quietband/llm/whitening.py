"""Whitening of vectors by a matrix-free block Jacobi-Davidson eigensolver.

The covariance is never formed: Spark multiplies it with a narrow block of vectors by
one pass over the centred rows, and only that product (as long as a vector, a few
columns wide) reaches the driver. There the solver keeps its search space: each round
takes Ritz vectors, locks the leading ones whose residual is at rounding level, and
extends the space by solving the projected correction equations of all others at once
with a few steps of MINRES, one pass over the rows per step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietband.llm.common import store
from quietband.llm.vectors import matrix
from quietband.session import partial_width

SCALE, SHIFT = 64, 1_000_000  # fixed values of the integer form of a component
# Components beyond this give integers that no sum of longs could hold; they count as this value.
LARGEST = float(1 << 52)
BLOCK_ROWS = 4096
# Eigenvalues below this share of the largest cannot be told from zero.
RANK_TOLERANCE = 1e-13


def whiten(
    vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``.

    One row per kept row and component, ``min(components, length)`` of them. Rows whose
    vector is NULL, empty or holds NULL or non-finite entries are left out, as are those
    of another length than the most frequent one (the longer of equally frequent ones).
    Zero vectors, repeated rows and NULL ids stay; the fit counts each distinct integer
    vector once. ``deviation`` is NULL where it exceeds a long. A component without
    variance (fewer distinct vectors than components, say) has NULL in ``whitened`` and
    does not enter ``identity_error``; ``explained`` is NULL if nothing varies at all.
    No kept row, no result.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kept = kept.where(F.coalesce((F.size("v") > 0) & ~F.exists("v", bad), F.lit(False)))
    common = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = (
        f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = common["d"]

    def whole(c):
        steps = F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST)))
        return steps.cast("long") + SHIFT

    kept = kept.where(F.size("v") == d).select("id", F.transform("v", whole).alias("x"))
    model = fit(kept.select("x"), d, min(components, d))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, BLOCK_ROWS):
                cut = batch.slice(part, BLOCK_ROWS)
                yield _rows(cut.column(0), integers(cut.column(1)), model, id_col)

    return kept.mapInArrow(project, schema)


@dataclass
class Whitening:
    """Centre ``low + rest / n`` of the fit list, its leading eigenpairs and how exact they are."""

    n: int
    low: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Exact integer part first, so that nothing is lost to the common offset."""
        return (x - self.low).astype(np.float64) - self.rest / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        # Added up in one order for every row: BLAS rounds equal rows differently at other places of a block.
        out = np.zeros((self.vectors.shape[1], len(x)))
        for column, weights in zip(np.ascontiguousarray(self.centred(x).T), self.vectors):
            out += weights[:, None] * column
        return out.T * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of ``n * x - S``; NULL where a long cannot hold it."""
        about = ((self.centred(x) * self.n) ** 2).sum(1)
        fits = about < 9.2e18
        exact = np.zeros(len(x), np.int64)
        exact[fits] = ((self.n * (x[fits] - self.low) - self.rest) ** 2).sum(1)
        return [int(v) if ok else None for v, ok in zip(exact, fits)]


def _rows(ids: pa.Array, x: np.ndarray, model: Whitening, id_col: str) -> pa.RecordBatch:
    k = len(model.values)
    owner = np.repeat(np.arange(len(x)), k)
    white = model.apply(x).ravel()
    share = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
    n_rows = len(owner)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(owner)),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
            pa.array(np.full(n_rows, model.n, np.int64)),
            pa.array(model.deviation(x), pa.int64()).take(pa.array(owner)),
            pa.array(white, mask=np.isnan(white)),
            pa.array(np.tile(share, len(x)), mask=np.isnan(np.tile(share, len(x)))),
            pa.array([model.identity_error] * n_rows, pa.float64()),
        ],
        names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
    )


def integers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit(rows: DataFrame, d: int, components: int) -> Whitening:
    """Fit on the distinct vectors of ``rows`` (one column ``x`` of ``d`` longs)."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                x = integers(batch.column(0).slice(start, BLOCK_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["block"])

    blocks = store(rows.distinct().mapInArrow(block, "block binary"), "fit")
    totals = _sums(blocks, d, 1 + d, lambda x: np.append(len(x), x.sum(0)), "long")
    n, sums = int(totals[0]), totals[1:]
    model = Whitening(n, sums // n, sums % n, np.eye(d, components), np.zeros(components), 0.0, None)
    model.trace = float(_sums(blocks, d, 1, lambda x: [(model.centred(x) ** 2).sum() / n])[0])
    if model.trace == 0:
        return model

    def product(p: np.ndarray) -> np.ndarray:
        def partial(x):
            c = model.centred(x)
            return c.T @ (c @ p) / n

        return _sums(blocks, d, p.size, partial).reshape(p.shape)

    values, vectors = jacobi_davidson(product, d, components)
    model.values = np.where(values > RANK_TOLERANCE * values[0], values, 0.0)
    model.vectors = vectors
    live = int((model.values > 0).sum())
    mean = _sums(blocks, d, live, lambda x: model.apply(x)[:, :live].sum(0) / n)

    def spread(x):
        w = model.apply(x)[:, :live] - mean
        return w.T @ w / n

    covariance = _sums(blocks, d, live * live, spread).reshape(live, live)
    model.identity_error = float(np.abs(covariance - np.eye(live)).max())
    return model


def _sums(blocks: DataFrame, d: int, slots: int, reduce_rows: Callable, kind: str = "double") -> np.ndarray:
    """``reduce_rows`` of every block, added up slot by slot: within tasks, then by a shuffle on the slot."""

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for raw in batch.column(0):
                part = np.ravel(reduce_rows(np.frombuffer(raw.as_py(), np.int64).reshape(-1, d)))
                held = part if held is None else held + part
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(slots, dtype=np.int64)), pa.array(held)], names=["slot", "value"]
            )

    parts = blocks.coalesce(partial_width(blocks)).mapInArrow(accumulate, f"slot long, value {kind}")
    found = parts.groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(slots, np.int64 if kind == "long" else np.float64)
    out[found["slot"].to_numpy()] = found["value"].to_numpy()
    return out


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray],
    d: int,
    wanted: int,
    spare: int = 4,
    max_basis: int = 96,
    inner_steps: int = 6,
    max_rounds: int = 300,
    seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, falling, with unit vectors.

    ``product`` multiplies a block of columns; it is all that is known of the operator.
    A pair is locked once its residual is at rounding level of the largest eigenvalue.
    """
    rng = np.random.default_rng(seed)
    locked, locked_values = np.zeros((d, 0)), np.zeros(0)
    basis = np.linalg.qr(rng.normal(size=(d, min(wanted + spare, d))))[0]
    image = product(basis)
    max_basis = max(max_basis, 2 * (wanted + spare))
    tolerance = 32 * np.finfo(float).eps * np.sqrt(d)
    for _ in range(max_rounds):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        need = min(wanted - locked.shape[1], basis.shape[1])
        residual = _without(locked, image[:, :need] - basis[:, :need] * values[:need])
        largest = max(values[0], *locked_values) if len(locked_values) else values[0]
        whole_space = locked.shape[1] + basis.shape[1] == d
        small_enough = np.linalg.norm(residual, axis=0) <= tolerance * abs(largest)
        ready = need if whole_space else int(np.append(np.flatnonzero(~small_enough), need)[0])
        if ready:
            locked = np.linalg.qr(np.hstack([locked, basis[:, :ready]]))[0]
            locked_values = np.append(locked_values, values[:ready])
            basis, image = basis[:, ready:], image[:, ready:]
            values, residual, need = values[ready:], residual[:, ready:], need - ready
        if locked.shape[1] == wanted:
            break
        if basis.shape[1] + need > max_basis:
            keep = wanted - locked.shape[1] + spare
            basis, image = basis[:, :keep], image[:, :keep]
        known = np.hstack([locked, basis[:, :need]])
        shift = values[:need]

        def correction(t, known=known, shift=shift):
            t = _without(known, t)
            return _without(known, product(t) - t * shift)

        steps = _minres(correction, -_without(known, residual), inner_steps)
        added = _independent(np.hstack([locked, basis]), steps, rng)
        basis, image = np.hstack([basis, added]), np.hstack([image, product(added)])
    else:
        raise ArithmeticError(f"{wanted - locked.shape[1]} eigenpairs did not converge")
    small = locked.T @ product(locked)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], locked @ turn[:, ::-1]


def _without(space: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The part of each column that is orthogonal to the space."""
    return block - space @ (space.T @ block)


def _independent(space: np.ndarray, block: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns outside the space; columns that add nothing give way to random ones."""
    out = space
    room = len(space) - space.shape[1]
    for column in block.T[:room]:
        for _ in range(4):
            size = np.linalg.norm(column)
            for _ in range(3):
                column = _without(out, column[:, None])[:, 0]
            left = np.linalg.norm(column)
            if left > 1e-8 * size and left > 0:
                break
            column = rng.normal(size=len(column))
        out = np.hstack([out, (column / np.linalg.norm(column))[:, None]])
    return out[:, space.shape[1] :]


def _minres(operator: Callable, rhs: np.ndarray, steps: int) -> np.ndarray:
    """A few MINRES steps for all columns side by side, each with scalars of its own."""
    tiny = np.finfo(float).tiny
    safe = lambda a: np.where(np.abs(a) > tiny, a, np.inf)
    beta = np.linalg.norm(rhs, axis=0)
    x, old, now = np.zeros_like(rhs), np.zeros_like(rhs), rhs / safe(beta)
    before, last = np.zeros_like(rhs), np.zeros_like(rhs)
    eta, c0, c1, s0, s1 = beta, 1.0, 1.0, 0.0, 0.0
    for _ in range(steps):
        next_ = operator(now)
        alpha = (now * next_).sum(0)
        next_ = next_ - alpha * now - beta * old
        size = np.linalg.norm(next_, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        length = np.hypot(delta, size)
        second, third = s1 * alpha + c0 * c1 * beta, s0 * beta
        c0, c1, s0, s1 = c1, delta / safe(length), s1, size / safe(length)
        before, last = last, (now - third * before - second * last) / safe(length)
        x = x + c1 * eta * last
        eta = -s1 * eta
        old, now, beta = now, next_ / safe(size), size
    return x
