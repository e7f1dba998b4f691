"""Graph Fourier transform of rows, power spectra and frequency bands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietband.functions import smallmath
from quietband.functions.partials import partial_sums
from quietband.functions.vectors import matmul
from quietband.operators.feature_graph import FeatureGraph, width_of

GAP_RATIO = 3.0
DEFAULT_BANDS = 3
DOMINANT = 5
# Wider spectra are summed in NumPy blocks instead of one aggregate per component.
MAX_AGGREGATES = 64


@dataclass(frozen=True)
class Basis:
    """Laplacian eigenvectors as columns, ascending eigenvalues."""

    values: np.ndarray
    vectors: np.ndarray

    def to_df(self, spark) -> DataFrame:
        rows = [
            (k, float(v), [float(x) for x in self.vectors[:, k]]) for k, v in enumerate(self.values)
        ]
        return spark.createDataFrame(rows, "k int, eigenvalue double, vector array<double>")


@dataclass(frozen=True)
class Spectrum:
    """Everything the spectral phase hands on."""

    coefficients: DataFrame
    basis: Basis
    power: DataFrame
    bands: list[tuple[int, int, str, float]]

    @property
    def band_edges(self) -> list[tuple[int, int]]:
        return [(start, end) for start, end, _, _ in self.bands]


def fit_basis(
    edges: DataFrame, d: int, n_components: int | None = None, normalized: bool = False
) -> Basis:
    """Eigenbasis of the column graph; only its d x d edges reach the driver."""
    smallmath.check_width(d)
    weights = smallmath.symmetric(edges.select("i", "j", "weight").toPandas(), d)
    lap = smallmath.laplacian_matrix(weights, normalized)
    return Basis(*smallmath.sorted_eigen(lap, n_components))


def gft(df: DataFrame, basis: Basis, vector: str = "features", out: str = "coeffs") -> DataFrame:
    """Rotate every row into the graph eigenbasis."""
    return df.withColumn(out, matmul(F.col(vector), basis.vectors))


def gft_subset(df: DataFrame, predicate: Column, basis: Basis, **columns) -> DataFrame:
    return gft(df.where(predicate), basis, **columns)


def inverse_gft(
    df: DataFrame, basis: Basis, coeffs: str = "coeffs", out: str = "features"
) -> DataFrame:
    return df.withColumn(out, matmul(F.col(coeffs), basis.vectors.T))


def point_power(coeffs: Column) -> Column:
    return F.transform(coeffs, lambda c: c * c)


def mean_power(df: DataFrame, coeffs: str = "coeffs", d: int | None = None) -> DataFrame:
    """``(k, power)``: mean squared coefficient of each component over all rows."""
    d = d or width_of(df, coeffs)
    if d <= MAX_AGGREGATES:
        cells = [F.get(F.col(coeffs), F.lit(k)) for k in range(d)]
        row = df.agg(F.array(*[F.avg(c * c) for c in cells]).alias("p"))
        return row.select(F.posexplode("p").alias("k", "power"))

    def block(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(rows)], (rows**2).sum(axis=0)])

    sums = partial_sums(df, coeffs, d + 1, block)
    n = sums.where(F.col("slot") == 0).select("value").scalar()
    found = sums.where(F.col("slot") > 0).select(
        (F.col("slot") - 1).cast("int").alias("k"), (F.col("value") / n).alias("power")
    )
    every = df.sparkSession.range(d).select(F.col("id").cast("int").alias("k"))
    return every.join(found, "k", "left").na.fill({"power": 0.0})


def cumulative_power(power: DataFrame) -> DataFrame:
    """``(k, cumulative)``: running share of the total power; zeros without power."""
    # One row per column of the data, so a single ordered window is small.
    total = F.sum("power").over(Window.partitionBy())
    running = F.sum("power").over(Window.orderBy("k"))
    share = F.when(total < 1e-12, 0.0).otherwise(F.try_divide(running, total))
    return power.select("k", share.alias("cumulative"))


def dominant_components(power: DataFrame, n: int = DOMINANT) -> DataFrame:
    return power.orderBy(F.desc("power"), "k").limit(n)


def spectral_centroid(power: DataFrame, basis: DataFrame) -> DataFrame:
    """Power-weighted mean eigenvalue."""
    total = F.sum("power")
    weighted = F.try_divide(F.sum(F.col("power") * F.col("eigenvalue")), total)
    return power.join(F.broadcast(basis.select("k", "eigenvalue")), "k").agg(
        F.when(total < 1e-12, 0.0).otherwise(weighted).alias("centroid")
    )


def compare_spectra(left: DataFrame, right: DataFrame) -> DataFrame:
    other = right.select("k", F.col("power").alias("other"))
    gap = F.col("power") - F.col("other")
    return left.join(other, "k").agg(F.sqrt(F.sum(gap * gap)).alias("distance"))


def spectral_gaps(power: DataFrame) -> DataFrame:
    """Components ``k`` after which the power jumps up by over 3x the median ratio."""
    following = F.lead("power").over(Window.orderBy("k"))
    ratios = power.select("k", (following / F.greatest("power", F.lit(1e-10))).alias("ratio"))
    ratios = ratios.where(F.col("ratio").isNotNull())
    median = ratios.agg(F.median("ratio")).scalar()
    return ratios.where((median >= 1e-10) & (F.col("ratio") > GAP_RATIO * median))


def bands_from_gaps(gaps: DataFrame, d: int) -> DataFrame:
    """Inclusive intervals ``(band, start, end)`` that cover 0..d-1, cut after each gap."""
    marks = gaps.where(F.col("k") + 1 < d).select("k", F.lit(1).alias("gap"))
    components = gaps.sparkSession.range(d).select(F.col("id").cast("int").alias("k"))
    flagged = components.join(F.broadcast(marks), "k", "left")
    earlier = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    band = F.coalesce(F.sum("gap").over(earlier), F.lit(0)).cast("int")
    return (
        flagged.select("k", band.alias("band"))
        .groupBy("band")
        .agg(F.min("k").alias("start"), F.max("k").alias("end"))
    )


def uniform_bands(spark, d: int, n_bands: int = DEFAULT_BANDS) -> DataFrame:
    """``n_bands`` intervals of nearly equal width, edges rounded half to even."""
    n = min(n_bands, d)
    edge = lambda i: F.bround(F.lit(float(d)) * i / n, 0).cast("int")
    return spark.range(n).select(
        F.col("id").cast("int").alias("band"),
        edge(F.col("id")).alias("start"),
        (edge(F.col("id") + 1) - 1).alias("end"),
    )


def label_bands(bands: DataFrame) -> DataFrame:
    """Name bands by position: all | dc noise | dc mid noise | dc low mid.. high noise."""
    n = F.count("*").over(Window.partitionBy())
    b = F.col("band")
    label = (
        F.when(n == 1, "all")
        .when(b == 0, "dc")
        .when(b == n - 1, "noise")
        .when((n >= 4) & (b == 1), "low")
        .when((n >= 4) & (b == n - 2), "high")
        .otherwise("mid")
    )
    return bands.withColumn("label", label)


def band_slice(coeffs: Column, start: int, end: int) -> Column:
    return F.slice(coeffs, start + 1, end - start + 1)


def band_power(bands: DataFrame, power: DataFrame, n_rows) -> DataFrame:
    """Total squared energy of every band, from the mean spectrum of ``n_rows`` rows."""
    inside = F.explode(F.sequence("start", "end")).alias("k")
    return (
        bands.select("band", inside)
        .join(power, "k")
        .groupBy("band")
        .agg((F.sum("power") * n_rows).alias("power"))
    )


def validate_band_coverage(bands: DataFrame, d: int) -> DataFrame:
    """Whether each of 0..d-1 lies in exactly one band."""
    k = F.explode(F.sequence("start", "end")).alias("k")
    return bands.select(k).agg(
        (
            (F.count("*") == d) & (F.count_distinct("k") == d) & (F.min("k") == 0) & (F.max("k") == d - 1)
        ).alias("covered")
    )


def analyze_fourier(
    df: DataFrame,
    graph: FeatureGraph,
    vector: str = "features",
    n_bands: int = DEFAULT_BANDS,
    basis: Basis | None = None,
) -> Spectrum:
    """Transform, mean spectrum and labelled bands of a table of points."""
    if graph is None and basis is None:
        raise ValueError("the graph Fourier transform needs a feature graph")
    basis = basis or fit_basis(graph.edges, len(graph.nodes))
    d = basis.vectors.shape[1]
    spark = df.sparkSession
    coefficients = gft(df, basis, vector)
    power = mean_power(coefficients, "coeffs", d)
    power = spark.createDataFrame(power.orderBy("k").toPandas(), "k int, power double")  # d rows
    gaps = spectral_gaps(power)
    bands = uniform_bands(spark, d, n_bands) if gaps.isEmpty() else bands_from_gaps(gaps, d)
    labelled = label_bands(bands)
    energy = band_power(bands, power, F.lit(float(df.count())))
    rows = labelled.join(energy, "band").orderBy("band").collect()  # at most d rows
    return Spectrum(
        coefficients,
        basis,
        power,
        [(r["start"], r["end"], r["label"], r["power"]) for r in rows],
    )
