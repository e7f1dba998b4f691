"""Queries over neighbours, intrinsic dimension, vector expressions and spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quietband.functions.vectors import (
    l2_normalize,
    normal_projection,
    project_onto_subspace,
    squared_norm,
    tangent_projection,
)
from quietband.operators import dimension, neighbors, spectral
from quietband.operators.feature_graph import FeatureGraph, correlation_edges
from quietband.plans.catalog_tables import CORR_SQL
from quietband.plans.inputs import (
    EMBED_D,
    EMBED_SQL,
    PAIRS_SQL,
    PATH_COLS,
    PATH_SQL,
    STD_SQL,
    cells,
    embedding_points,
    order_points,
    path_graph,
    r,
    rounded,
    stored_order_points,
)
from quietband.plans.registry import query
from quietband.session import cut_lineage

# --- neighbours ------------------------------------------------------------------------------


def knn_sql(k: int) -> str:
    return f"""WITH {PAIRS_SQL} SELECT query, neighbor, CAST(rank AS BIGINT) AS rank,
  round(sq, 6) + 0.0 AS sq_distance FROM rk WHERE rank < {k}"""


@query("knn_exact", knn_sql(10))
def knn_exact_query(spark, sf_dir):
    return rounded(neighbors.knn_exact(embedding_points(spark, sf_dir), 10))


# Small batches: many rounds of distances within a task.
@query("batch_knn", knn_sql(5))
def batch_knn_query(spark, sf_dir):
    return rounded(neighbors.batch_knn(embedding_points(spark, sf_dir), 5, batch_size=50))


@query("knn_approx_all_cells", knn_sql(5))
def knn_approx_all_cells(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    return rounded(neighbors.knn_approx(points, 5, n_cells=16, n_probe=16))


@query("knn_approx")
def knn_approx_query(spark, sf_dir):
    return rounded(neighbors.knn_approx(embedding_points(spark, sf_dir), 5))


@query(
    "radius_search",
    f"WITH {PAIRS_SQL} SELECT query, neighbor, round(sq, 6) + 0.0 AS sq_distance FROM prs WHERE sq < 1.44",
)
def radius_search_query(spark, sf_dir):
    return rounded(neighbors.radius_search(embedding_points(spark, sf_dir), 1.2))


@query(
    "pairwise_distance",
    f"""WITH {EMBED_SQL}, u AS (SELECT label, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM emb),
c AS (SELECT label, list(m ORDER BY k) AS v FROM (SELECT label, k, avg(x) AS m FROM u GROUP BY label, k) GROUP BY label)
SELECT emb.id AS id, CAST(c.label AS BIGINT) AS target,
  round(list_sum(list_transform(list_zip(emb.v, c.v), lambda p: abs(p[1] - p[2]))), 6) + 0.0 AS distance
  FROM emb CROSS JOIN c""",
)
def pairwise_distance_query(spark, sf_dir):
    """City-block distance of every embedding to the mean of every label."""
    points = embedding_points(spark, sf_dir)
    means = points.groupBy(F.col("label").alias("id")).agg(
        F.array(*[F.avg(F.get("features", F.lit(k))) for k in range(EMBED_D)]).alias("features")
    )
    matrix = neighbors.pairwise_distance(points, means, "cityblock")
    flat = matrix.select("id", F.explode(F.arrays_zip("targets", "distances")).alias("t"))
    return rounded(flat.select("id", F.col("t.targets").alias("target"), F.col("t.distances").alias("distance")))


@query(
    "knn_graph",
    f"""WITH {PAIRS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sq, neighbor) AS place
  FROM prs WHERE query <> neighbor)
SELECT DISTINCT least(query, neighbor) AS i, greatest(query, neighbor) AS j, 1.0::DOUBLE AS weight FROM o WHERE place <= 5""",
)
def knn_graph_query(spark, sf_dir):
    return neighbors.knn_graph(embedding_points(spark, sf_dir), 5)


# --- intrinsic dimension -------------------------------------------------------------------------

MLE_SQL = f"""{PAIRS_SQL}, nn AS (SELECT query, rank, greatest(sqrt(sq), 1e-10) AS d,
  sqrt(max(sq) OVER (PARTITION BY query)) AS far FROM rk WHERE rank BETWEEN 1 AND 19),
ml AS (SELECT query, avg(ln(far / d)) AS ml FROM nn WHERE rank < 19 GROUP BY query),
dims AS (SELECT query, 1 / ml AS dim FROM ml WHERE ml > 1e-10)"""


@query("local_mle", f"WITH {MLE_SQL} SELECT query, round(dim, 5) + 0.0 AS dim FROM dims")
def local_mle_query(spark, sf_dir):
    hits = neighbors.knn_exact(embedding_points(spark, sf_dir), dimension.NEIGHBORS)
    return rounded(dimension.local_mle(hits), 5)


@query("dim_mle", f"WITH {MLE_SQL} SELECT CAST(greatest(1, round_even(median(dim), 0)) AS BIGINT) AS dim FROM dims")
def dim_mle_query(spark, sf_dir):
    value = dimension.dim_mle(embedding_points(spark, sf_dir), "id")
    return spark.createDataFrame([(value,)], "dim long")


@query(
    "dim_consensus",
    f"""WITH {MLE_SQL}, e AS (SELECT CAST(round_even(median(dim), 0) AS BIGINT) AS dim FROM dims
  UNION ALL SELECT count(DISTINCT label) FROM emb UNION ALL SELECT max(len(v)) FROM emb)
SELECT CAST(greatest(1, least(median(dim), 63)) AS BIGINT) AS intrinsic_dim, min(dim) AS low, max(dim) AS high FROM e""",
)
def dim_consensus_query(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    labels = points.select("label").distinct().count()
    values = [(dimension.dim_mle(points, "id"),), (labels,), (EMBED_D,)]
    return dimension.dim_consensus(spark.createDataFrame(values, "dim long"), EMBED_D).select(
        F.col("intrinsic_dim").cast("long").alias("intrinsic_dim"), "low", "high"
    )


@query("dim_eigen_gap")
def dim_eigen_gap_query(spark, sf_dir):
    value = dimension.dim_eigen_gap(embedding_points(spark, sf_dir))
    return spark.createDataFrame([(value,)], "dim long")


def _with_sum(spark, sf_dir, columns):
    """Order points with the sum of their columns as a further one, which adds no dimension."""
    points = order_points(spark, sf_dir, columns)
    total = F.aggregate("features", F.lit(0.0), lambda a, b: a + b)
    return points.withColumn("features", F.concat("features", F.array(total)))


# Two columns and their sum: one eigenvalue is 0, the others solve a quadratic equation.
@query(
    "covariance_spectra",
    f"""WITH {STD_SQL}, m AS (SELECT covar_samp(x1, x4) AS c, var_samp(x1) AS a, var_samp(x4) AS b FROM pts),
t AS (SELECT 2 * (a + b + c) AS t, 3 * (a * b - c * c) AS m FROM m)
SELECT 0 AS k, round((t + sqrt(t * t - 4 * m)) / 2, 6) + 0.0 AS value, 1 AS dim FROM t
UNION ALL SELECT 1, round((t - sqrt(t * t - 4 * m)) / 2, 6) + 0.0, 1 FROM t UNION ALL SELECT 2, 0.0, 1""",
)
def covariance_spectra_query(spark, sf_dir):
    points = cut_lineage(_with_sum(spark, sf_dir, ["qty", "tax"]))
    values = dimension.covariance_spectra(points, "features")[0]
    gap = dimension.dim_eigen_gap(points)
    rows = [(k, abs(float(v)) if abs(v) < 1e-9 else float(v), gap) for k, v in enumerate(values)]
    return rounded(spark.createDataFrame(rows, "k int, value double, dim int"))


# Around rows of an exact plane two components explain everything.
@query("dim_local_pca_plane", "SELECT CAST(2 AS BIGINT) AS dim FROM orders LIMIT 1")
def dim_local_pca_plane(spark, sf_dir):
    points = cut_lineage(_with_sum(spark, sf_dir, ["price", "tax"]))
    return spark.createDataFrame([(dimension.dim_local_pca(points, "id"),)], "dim long")


# The only edge of two columns reaches its own mean; a plane has at most two dimensions.
@query(
    "discover_structure_pair",
    """SELECT 'graph' AS structure, 'graph_fourier' AS transform, true AS dim_fits, CAST(1 AS BIGINT) AS n_edges,
  1.0::DOUBLE AS density, CAST(1 AS BIGINT) AS n_components, 1.0::DOUBLE AS avg_degree FROM orders LIMIT 1""",
)
def discover_structure_pair(spark, sf_dir):
    points = stored_order_points(spark, sf_dir, ["price", "tax"])
    graph, found = dimension.discover_structure(points, "id", "exact")
    fits = F.col("intrinsic_dim").between(1, 2).alias("dim_fits")
    return rounded(found.select("structure", "transform", fits, "n_edges", "density", "n_components", "avg_degree"))


@query("dim_local_pca")
def dim_local_pca_query(spark, sf_dir):
    value = dimension.dim_local_pca(embedding_points(spark, sf_dir), "id")
    return spark.createDataFrame([(value,)], "dim long")


@query("discover_structure")
def discover_structure_query(spark, sf_dir):
    return dimension.discover_structure(stored_order_points(spark, sf_dir), "id")[1]


# --- vector expressions -----------------------------------------------------------------------------

LINE = np.array([[1.0, 1.0, 1.0, 0.0, 0.0]]) / np.sqrt(3)
PROJECTED = ", ".join(f"{r('(x0 + x1 + x2) / 3' if i < 3 else '0.0::DOUBLE')} AS x{i}" for i in range(5))
NORMAL = ", ".join(f"{r(f'x{i} - (x0 + x1 + x2) / 3' if i < 3 else f'x{i}')} AS x{i}" for i in range(5))


def _mapped(spark, sf_dir, expression):
    points = order_points(spark, sf_dir).withColumn("features", expression)
    return rounded(points.select("id", *cells("features", 5)))


@query("project_onto_subspace", f"WITH {STD_SQL} SELECT id, {PROJECTED} FROM pts")
def project_onto_subspace_query(spark, sf_dir):
    return _mapped(spark, sf_dir, project_onto_subspace(F.col("features"), LINE))


@query("tangent_projection", f"WITH {STD_SQL} SELECT id, {PROJECTED} FROM pts")
def tangent_projection_query(spark, sf_dir):
    return _mapped(spark, sf_dir, tangent_projection(F.col("features"), LINE.T))


@query("normal_projection", f"WITH {STD_SQL} SELECT id, {NORMAL} FROM pts")
def normal_projection_query(spark, sf_dir):
    return _mapped(spark, sf_dir, normal_projection(F.col("features"), LINE.T))


LENGTH = "sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3 + x4 * x4)"


@query(
    "l2_normalize",
    f"WITH {STD_SQL} SELECT id, " + ", ".join(f"{r(f'x{i} / {LENGTH}')} AS x{i}" for i in range(5)) + " FROM pts",
)
def l2_normalize_query(spark, sf_dir):
    return _mapped(spark, sf_dir, l2_normalize(F.col("features")))


@query("tall_svd", f"WITH {EMBED_SQL}, u AS (SELECT unnest(v) AS x FROM emb) SELECT {r('sum(x * x)', 4)} AS energy FROM u")
def tall_svd_query(spark, sf_dir):
    values, _ = dimension.tall_svd(embedding_points(spark, sf_dir))
    return rounded(spark.createDataFrame([(float((values**2).sum()),)], "energy double"), 4)


# --- spectra over a fixed path graph -------------------------------------------------------------------


def _path(spark, sf_dir):
    points = order_points(spark, sf_dir, PATH_COLS)
    return points, spectral.fit_basis(path_graph(spark), 3)


def _path_gft(spark, sf_dir):
    points, basis = _path(spark, sf_dir)
    return spectral.gft(points, basis), basis


COEFFS = ", ".join(f"{r(f'c{k}')} AS c{k}" for k in range(3))
POWER_SQL = (
    PATH_SQL
    + ", pw AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, avg(c{k} * c{k}) AS power FROM gft" for k in range(3))
    + "), eig AS (SELECT 0 AS k, 0.0 AS eigenvalue UNION ALL SELECT 1, 1.0 UNION ALL SELECT 2, 3.0)"
)


# Trace of the Laplacian: eigenvalues add up to twice the weights.
@query("fit_basis", f"WITH {CORR_SQL} SELECT count(*) / 2 AS n, {r('2 * sum(weight)')} AS trace FROM ce")
def fit_basis_query(spark, sf_dir):
    basis = spectral.fit_basis(correlation_edges(order_points(spark, sf_dir)), 5)
    rows = basis.to_df(spark).agg(
        F.count("*").cast("double").alias("n"), F.sum("eigenvalue").alias("trace")
    )
    return rounded(rows)


@query("gft", f"WITH {PATH_SQL} SELECT id, {COEFFS} FROM gft")
def gft_query(spark, sf_dir):
    return rounded(_path_gft(spark, sf_dir)[0].select("id", *cells("coeffs", 3, "c")))


# A fitted basis has no closed form, but it keeps the length of every row.
@query("gft_fitted", f"WITH {STD_SQL} SELECT id, {r('x0*x0 + x1*x1 + x2*x2 + x3*x3 + x4*x4', 5)} AS energy FROM pts")
def gft_fitted_query(spark, sf_dir):
    points = order_points(spark, sf_dir)
    rotated = spectral.gft(points, spectral.fit_basis(correlation_edges(points), 5))
    return rounded(rotated.select("id", squared_norm(F.col("coeffs")).alias("energy")), 5)


@query("gft_subset", f"WITH {PATH_SQL} SELECT id, {COEFFS} FROM gft WHERE id % 2 = 0")
def gft_subset_query(spark, sf_dir):
    points, basis = _path(spark, sf_dir)
    rows = spectral.gft_subset(points, F.col("id") % 2 == 0, basis)
    return rounded(rows.select("id", *cells("coeffs", 3, "c")))


@query(
    "inverse_gft",
    f"WITH {STD_SQL} SELECT id, " + ", ".join(f"{r(f'x{i}')} AS x{i}" for i in range(3)) + " FROM pts",
)
def inverse_gft_query(spark, sf_dir):
    rotated, basis = _path_gft(spark, sf_dir)
    back = spectral.inverse_gft(rotated.drop("features"), basis)
    return rounded(back.select("id", *cells("features", 3)))


@query(
    "point_power",
    f"WITH {PATH_SQL} SELECT id, " + ", ".join(f"{r(f'c{k} * c{k}', 5)} AS p{k}" for k in range(3)) + " FROM gft",
)
def point_power_query(spark, sf_dir):
    rotated, _ = _path_gft(spark, sf_dir)
    powers = rotated.withColumn("p", spectral.point_power(F.col("coeffs")))
    return rounded(powers.select("id", *cells("p", 3, "p")), 5)


def _path_power(spark, sf_dir):
    rotated, basis = _path_gft(spark, sf_dir)
    return spectral.mean_power(rotated, d=3), basis


@query("mean_power", f"WITH {POWER_SQL} SELECT k, {r('power')} AS power FROM pw")
def mean_power_query(spark, sf_dir):
    return rounded(_path_power(spark, sf_dir)[0])


@query(
    "cumulative_power",
    f"WITH {POWER_SQL} SELECT k, {r('sum(power) OVER (ORDER BY k) / sum(power) OVER ()')} AS cumulative FROM pw",
)
def cumulative_power_query(spark, sf_dir):
    return rounded(spectral.cumulative_power(_path_power(spark, sf_dir)[0]))


@query("dominant_components", f"WITH {POWER_SQL} SELECT k, {r('power')} AS power FROM pw ORDER BY pw.power DESC, k LIMIT 2")
def dominant_components_query(spark, sf_dir):
    return rounded(spectral.dominant_components(_path_power(spark, sf_dir)[0], 2))


@query(
    "spectral_centroid",
    f"""WITH {POWER_SQL} SELECT {r('sum(power * eigenvalue) / sum(power)')} AS centroid
  FROM pw JOIN eig ON pw.k = eig.k""",
)
def spectral_centroid_query(spark, sf_dir):
    power, basis = _path_power(spark, sf_dir)
    return rounded(spectral.spectral_centroid(power, basis.to_df(spark)))


EMBED_POWER_SQL = f"""{EMBED_SQL}, u AS (SELECT id, label, generate_subscripts(v, 1) - 1 AS k, unnest(v) AS x FROM emb),
ep AS (SELECT k, avg(x * x * (1 + 3 * (k % 9)) * (1 + 3 * (k % 9))) AS power FROM u GROUP BY k)"""


def _stepped_power(spark, sf_dir):
    """Embedding components scaled by 1, 4, .. 25 in turn, so that the spectrum has jumps."""
    scaled = embedding_points(spark, sf_dir).select(
        F.transform("features", lambda x, k: x * (1 + 3 * (k % 9))).alias("coeffs")
    )
    return spectral.mean_power(scaled, d=EMBED_D)


@query(
    "compare_spectra",
    f"""WITH {EMBED_SQL}, u AS (SELECT label, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM emb),
p AS (SELECT k, avg(x * x) FILTER (WHERE label < 5) AS a, avg(x * x) FILTER (WHERE label >= 5) AS b FROM u GROUP BY k)
SELECT {r('sqrt(sum((a - b) * (a - b)))', 9)} AS distance FROM p""",
)
def compare_spectra_query(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    low = spectral.mean_power(points.where("label < 5"), "features", EMBED_D)
    high = spectral.mean_power(points.where("label >= 5"), "features", EMBED_D)
    return rounded(spectral.compare_spectra(low, high), 9)


GAP_SQL = f"""{EMBED_POWER_SQL}, ra AS (SELECT k, lead(power) OVER (ORDER BY k) / greatest(power, 1e-10) AS ratio FROM ep),
gap AS (SELECT k, ratio FROM ra WHERE ratio > 3 * (SELECT median(ratio) FROM ra)),
bd AS (SELECT g AS band, min(k) AS s, max(k) AS e FROM (SELECT ep.k, (SELECT count(*) FROM gap WHERE gap.k < ep.k) AS g
  FROM ep) GROUP BY g)"""


@query("spectral_gaps", f"WITH {GAP_SQL} SELECT k, {r('ratio')} AS ratio FROM gap")
def spectral_gaps_query(spark, sf_dir):
    return rounded(spectral.spectral_gaps(_stepped_power(spark, sf_dir)))


@query("bands_from_gaps", f'WITH {GAP_SQL} SELECT band, s AS "start", e AS "end" FROM bd')
def bands_from_gaps_query(spark, sf_dir):
    gaps = spectral.spectral_gaps(_stepped_power(spark, sf_dir))
    return rounded(spectral.bands_from_gaps(gaps, EMBED_D))


@query(
    "label_bands",
    f"""WITH {GAP_SQL}, n AS (SELECT count(*) AS n FROM bd) SELECT band, CASE WHEN band = 0 THEN 'dc'
  WHEN band = n - 1 THEN 'noise' WHEN band = 1 THEN 'low' WHEN band = n - 2 THEN 'high' ELSE 'mid' END AS label
  FROM bd CROSS JOIN n""",
)
def label_bands_query(spark, sf_dir):
    gaps = spectral.spectral_gaps(_stepped_power(spark, sf_dir))
    return rounded(spectral.label_bands(spectral.bands_from_gaps(gaps, EMBED_D)).select("band", "label"))


@query("validate_band_coverage", f"WITH {GAP_SQL} SELECT sum(e - s + 1) = 64 AS covered FROM bd")
def validate_band_coverage_query(spark, sf_dir):
    gaps = spectral.spectral_gaps(_stepped_power(spark, sf_dir))
    return spectral.validate_band_coverage(spectral.bands_from_gaps(gaps, EMBED_D), EMBED_D)


@query(
    "uniform_bands_power",
    f"""WITH {EMBED_SQL}, u AS (SELECT generate_subscripts(v, 1) - 1 AS k, unnest(v) AS x FROM emb),
b AS (SELECT b AS band, CAST(round_even(64.0 * b / 5, 0) AS BIGINT) AS s,
  CAST(round_even(64.0 * (b + 1) / 5, 0) AS BIGINT) - 1 AS e FROM range(5) t(b))
SELECT band, s AS "start", e AS "end", {r('sum(x * x)', 4)} AS power FROM b JOIN u ON k BETWEEN s AND e GROUP BY band, s, e""",
)
def uniform_bands_power_query(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    bands = spectral.uniform_bands(spark, EMBED_D, 5)
    power = spectral.mean_power(points, "features", EMBED_D)
    energy = spectral.band_power(bands, power, points.agg(F.count("*")).scalar())
    return rounded(bands.join(energy, "band"), 4)


@query("band_slice", f"WITH {STD_SQL} SELECT id, {r('x1')} AS x0, {r('x2')} AS x1, {r('x3')} AS x2 FROM pts")
def band_slice_query(spark, sf_dir):
    return rounded(
        order_points(spark, sf_dir)
        .select("id", spectral.band_slice(F.col("features"), 1, 3).alias("s"))
        .select("id", *cells("s", 3))
    )


# Three components never show a gap of three times their median ratio, so bands are uniform.
@query(
    "analyze_fourier",
    f"""WITH {POWER_SQL} SELECT k AS band, k AS "start", k AS "end",
  CASE k WHEN 0 THEN 'dc' WHEN 1 THEN 'mid' ELSE 'noise' END AS label,
  round(power * (SELECT count(*) FROM gft), 3) + 0.0 AS power FROM pw""",
)
def analyze_fourier_query(spark, sf_dir):
    points = order_points(spark, sf_dir, PATH_COLS)
    graph = FeatureGraph(path_graph(spark), PATH_COLS, None)
    found = spectral.analyze_fourier(points, graph)
    rows = [(b, *band) for b, band in enumerate(found.bands)]
    return rounded(
        spark.createDataFrame(rows, "band long, start long, end long, label string, power double"), 3
    )
