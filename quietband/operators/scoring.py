"""Residuals against local charts, per-band z-scores, thresholds and flags.

A point carries ``features`` and the ``chart_id`` it belongs to. Charts are a
handful of d x q bases that travel with the task; what is computed per point
(``norms``, ``z``, ``flags``) stays one array column, band by band.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietband.functions.quantiles import approx_quantiles, exact_quantiles
from quietband.functions.vectors import to_lists, to_matrix
from quietband.session import check_broadcast, cut_lineage

MAD_FACTOR = 3.0
MAD_TO_SIGMA = 1.4826
FLAT_STD = 1e-12
FLAT_GAP = 1e-10
EXTREME_Z = 1e10

# chart_id -> d x q matrix with orthonormal columns
Bases = dict[int, np.ndarray]


def _per_chart(vector: Column, chart: Column, apply, width: int) -> Column:
    """``apply(rows, chart_id)`` on the rows of each chart inside an Arrow batch."""

    @F.arrow_udf("array<double>")
    def mapped(vec: pa.Array, charts: pa.Array) -> pa.Array:
        rows = to_matrix(vec)
        if not len(rows):
            return to_lists(np.empty((0, width)))
        ids = charts.to_numpy(zero_copy_only=False)
        out = np.empty((len(rows), width))
        for chart_id in np.unique(ids):
            mine = ids == chart_id
            out[mine] = apply(rows[mine], int(chart_id))
        return to_lists(out)

    return mapped(vector, chart)


def _check_bases(bases: Bases) -> tuple[int, int]:
    d, q = next(iter(bases.values())).shape
    check_broadcast(len(bases), 8 * d * q, "the chart bases")
    return d, q


def chart_coordinates(df: DataFrame, bases: Bases, vector: str = "features") -> DataFrame:
    """Add ``coordinates``: the row in the basis of its chart."""
    _, q = _check_bases(bases)
    return df.withColumn(
        "coordinates",
        _per_chart(F.col(vector), F.col("chart_id"), lambda rows, c: rows @ bases[c], q),
    )


def chart_decode(df: DataFrame, bases: Bases, coordinates: str = "coordinates") -> DataFrame:
    """Add ``decoded``: chart coordinates mapped back to the original space."""
    d, _ = _check_bases(bases)
    return df.withColumn(
        "decoded",
        _per_chart(F.col(coordinates), F.col("chart_id"), lambda rows, c: rows @ bases[c].T, d),
    )


def reconstruct(df: DataFrame, bases: Bases, vector: str = "features") -> DataFrame:
    """Add ``reconstruction``: the projection of a row onto its chart."""
    d, _ = _check_bases(bases)
    return df.withColumn(
        "reconstruction",
        _per_chart(
            F.col(vector), F.col("chart_id"), lambda rows, c: (rows @ bases[c]) @ bases[c].T, d
        ),
    )


def normal_residuals(df: DataFrame, bases: Bases, vector: str = "features") -> DataFrame:
    """Add ``residual``, the part of a row off its chart.

    For linear charts this residual is its own normal-space projection.
    """
    d, _ = _check_bases(bases)
    return df.withColumn(
        "residual",
        _per_chart(
            F.col(vector),
            F.col("chart_id"),
            lambda rows, c: rows - (rows @ bases[c]) @ bases[c].T,
            d,
        ),
    )


def tangent_share(df: DataFrame, bases: Bases, vector: str = "features") -> DataFrame:
    """Mean share of the residual that lies in the tangent space, per chart."""
    _check_bases(bases)

    def share(rows: np.ndarray, c: int) -> np.ndarray:
        basis = bases[c]
        residual = rows - (rows @ basis) @ basis.T
        size = np.linalg.norm(residual, axis=1)
        inside = np.linalg.norm(residual @ basis, axis=1)
        return np.divide(inside, size, out=np.zeros_like(size), where=size >= 1e-12)[:, None]

    value = _per_chart(F.col(vector), F.col("chart_id"), share, 1)
    return df.groupBy("chart_id").agg(F.avg(F.get(value, F.lit(0))).alias("tangent_share"))


def band_norms(
    df: DataFrame,
    bases: Bases,
    eigenvectors: np.ndarray,
    bands: list[tuple[int, int]],
    vector: str = "features",
) -> DataFrame:
    """Add ``norms``: length of the residual inside every frequency band.

    Residual, rotation and band norms are one pass over an Arrow batch.
    """
    _check_bases(bases)
    d = eigenvectors.shape[0]
    check_broadcast(d, 8 * eigenvectors.shape[1], "the eigenvectors")
    slices = [slice(start, end + 1) for start, end in bands]

    def norms(rows: np.ndarray, c: int) -> np.ndarray:
        residual = rows - (rows @ bases[c]) @ bases[c].T
        spectrum = (residual @ eigenvectors) ** 2
        return np.sqrt(np.column_stack([spectrum[:, s].sum(axis=1) for s in slices]))

    return df.withColumn(
        "norms", _per_chart(F.col(vector), F.col("chart_id"), norms, len(bands))
    )


def expected_residuals(df: DataFrame, norms: str = "norms") -> DataFrame:
    """``(chart_id, band, mean, var, n)`` of the band norms, population variance."""
    return (
        df.select("chart_id", F.posexplode(norms).alias("band", "norm"))
        .groupBy("chart_id", "band")
        .agg(
            F.avg("norm").alias("mean"),
            F.var_pop("norm").alias("var"),
            F.count("*").alias("n"),
        )
    )


def band_zscore(df: DataFrame, expected: DataFrame, norms: str = "norms") -> DataFrame:
    """Add ``z``: band norms standardised by what the chart expects.

    A band without spread scores 0 on its mean and an extreme value off it; a
    chart without statistics scores like one with mean and variance 0.
    """
    entries = expected.groupBy("chart_id").agg(
        F.array_sort(F.collect_list(F.struct("band", "mean", "var"))).alias("_expected")
    )
    joined = df.join(F.broadcast(entries), "chart_id", "left")  # one row per chart

    def score(norm: Column, position: Column) -> Column:
        entry = F.get(F.col("_expected"), position)
        gap = norm - F.coalesce(entry["mean"], F.lit(0.0))
        std = F.sqrt(F.greatest(F.coalesce(entry["var"], F.lit(0.0)), F.lit(0.0)))
        flat = F.when(F.abs(gap) < FLAT_GAP, 0.0).otherwise(F.signum(gap) * EXTREME_Z)
        return F.when(std < FLAT_STD, flat).otherwise(F.try_divide(gap, std))

    return joined.withColumn("z", F.transform(F.col(norms), score)).drop("_expected")


def aggregate_score(z: Column, weights: list[float] | None = None) -> Column:
    """Largest absolute z, or the weighted mean of absolute z (weights normalised)."""
    size = F.transform(z, lambda x: F.abs(x))
    if weights is None:
        return F.coalesce(F.array_max(size), F.lit(0.0))
    total = sum(weights)
    scaled = [w / total if total else 1.0 / len(weights) for w in weights]
    return sum((F.get(size, F.lit(b)) * w for b, w in enumerate(scaled)), F.lit(0.0))


def _quantiles(df, columns, probs, exact):
    return exact_quantiles(df, columns, probs) if exact else approx_quantiles(df, columns, probs)


def mad_thresholds(
    df: DataFrame, columns: dict[str, Column], exact: bool = True
) -> dict[str, float]:
    """Median plus three scaled median absolute deviations of each expression."""
    medians = {n: v[0] for n, v in _quantiles(df, columns, [0.5], exact).items()}
    spread = {n: F.abs(c - medians[n]) for n, c in columns.items() if medians[n] is not None}
    mads = _quantiles(df, spread, [0.5], exact) if spread else {}
    return {
        n: 0.0 if medians[n] is None else medians[n] + MAD_FACTOR * MAD_TO_SIGMA * mads[n][0]
        for n in columns
    }


def percentile_thresholds(
    df: DataFrame, columns: dict[str, Column], percentile: float = 99.0, exact: bool = True
) -> dict[str, float]:
    found = _quantiles(df, columns, [percentile / 100.0], exact)
    return {n: 0.0 if v[0] is None else v[0] for n, v in found.items()}


def multiple_testing(thresholds: list[float]) -> list[float]:
    """Raise per-band thresholds by ``ln(bands) + 1``."""
    factor = math.log(len(thresholds)) + 1.0 if len(thresholds) > 1 else 1.0
    return [t * factor for t in thresholds]


def score_points(df: DataFrame, expected: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Add ``z`` and ``score`` to points with band norms."""
    scored = band_zscore(df, expected)
    return scored.withColumn("score", aggregate_score(F.col("z"), weights))


def thresholds_for(
    scores: DataFrame, n_bands: int, method: str = "mad", percentile: float = 99.0, exact: bool = True
) -> tuple[list[float], float]:
    """Corrected threshold of every band and the threshold of the overall score."""
    columns = {str(b): F.abs(F.get(F.col("z"), F.lit(b))) for b in range(n_bands)}
    columns["overall"] = F.col("score")
    if method == "mad":
        found = mad_thresholds(scores, columns, exact)
    else:
        found = percentile_thresholds(scores, columns, percentile, exact)
    return multiple_testing([found[str(b)] for b in range(n_bands)]), found["overall"]


def flag(scores: DataFrame, band_limits: list[float], overall_limit: float) -> DataFrame:
    """Add ``flags`` per band and ``is_anomaly``; both need a strict excess."""
    per_band = F.array(
        *[F.abs(F.get(F.col("z"), F.lit(b))) > limit for b, limit in enumerate(band_limits)]
    )
    return scores.withColumns({"flags": per_band, "is_anomaly": F.col("score") > overall_limit})


def detect_scores(
    normed: DataFrame,
    expected: DataFrame,
    n_bands: int,
    weights: list[float] | None = None,
    method: str = "mad",
    percentile: float = 99.0,
    exact: bool = True,
    keep=cut_lineage,
) -> DataFrame:
    """Score and flag points with band norms against given expectations.

    ``keep`` stores the scores, which the threshold passes read several times.
    """
    scores = keep(score_points(normed, expected, weights).drop("norms"))
    limits, overall = thresholds_for(scores, n_bands, method, percentile, exact)
    return flag(scores, limits, overall)


def detect_anomalies(
    points: DataFrame,
    bases: Bases,
    eigenvectors: np.ndarray,
    bands: list[tuple[int, int]],
    vector: str = "features",
    **options,
) -> DataFrame:
    """Score and flag points with ``chart_id`` by the statistics of their own charts."""
    normed = band_norms(points, bases, eigenvectors, bands, vector).drop(vector)
    return detect_scores(normed, expected_residuals(normed), len(bands), **options)
