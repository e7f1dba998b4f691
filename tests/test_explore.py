import numpy as np
import pytest
from pyspark.sql import functions as F

from quietband.operators import explore


@pytest.fixture(scope="module")
def run(spark):
    """300 points; the last 60 are flagged: far cluster 0, overlapping cluster 1, isolated."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)) * [0.1, 3.0, 3.0, 3.0, 0.3, 0.3]
    x[240:260, 1:4] += 60
    x[260:280, 4:] += 3
    labels = np.full(300, -1)
    labels[240:260], labels[260:280] = 0, 1
    rows = [
        (i, [float(v) for v in x[i]], float(i), i >= 240, int(labels[i])) for i in range(300)
    ]
    return x, spark.createDataFrame(
        rows, "id long, coeffs array<double>, score double, is_anomaly boolean, cluster int"
    )


def test_axes_skip_the_constant_component_of_wide_spectra(spark):
    power = lambda v: spark.createDataFrame(list(enumerate(map(float, v))), "k int, power double")
    assert [r[0] for r in explore.top3_axes(power([9, 1, 3, 2, 4])).collect()] == [2, 3, 4]
    assert [r[0] for r in explore.top3_axes(power([9, 1, 3])).collect()] == [0, 1, 2]


def test_projection_moves_only_overlapping_clusters(run):
    x, rows = run
    found = explore.project(
        rows.select("id", "coeffs"), "id", rows.select("id", "score", "is_anomaly"), rows.select("id", "cluster")
    )
    assert found.axes == [1, 2, 3]
    clusters = {r["cluster_id"]: r for r in found.clusters.collect()}
    assert not clusters[0]["overlaps"] and clusters[1]["overlaps"]
    assert clusters[0]["axes"] is None and {4, 5} <= set(clusters[1]["axes"])
    points = {r["id"]: r for r in found.points.collect()}
    kinds = [points[i]["klass"] for i in (0, 245, 265, 285)]
    assert kinds == ["normal", "cluster", "cluster", "isolated"]
    z = (x[:, [1, 2, 3]] - x[:, [1, 2, 3]].mean(axis=0)) / x[:, [1, 2, 3]].std(axis=0)
    assert [points[3][a] for a in "xyz"] == pytest.approx(z[3].tolist())
    moved = np.array([[points[i][a] for a in "xyz"] for i in range(260, 280)])
    assert all(points[i]["reprojected"] == (260 <= i < 280) for i in range(300))
    # 2.5 units from the (zero) centre of all points, with unit spread on each axis.
    assert np.allclose(moved.std(axis=0), 1.0)


def test_missing_scores_mean_everything_is_normal(run):
    _, rows = run
    found = explore.project(rows.select("id", "coeffs"), "id")
    assert found.points.where("klass = 'normal'").count() == 300 and found.clusters.count() == 0


def test_overlap_needs_two_normal_points(spark):
    rows = [(1, "normal", None, 0.0), (2, "cluster", 4, 0.0)]
    table = spark.createDataFrame(rows, "id long, klass string, cluster_id int, x double")
    placed = table.withColumns({"y": F.col("x"), "z": F.col("x")})
    assert not explore.cluster_overlap(placed).first()["overlaps"]


def test_cluster_detail(run):
    found = {r["cluster"]: r for r in explore.cluster_detail(run[1]).collect()}
    assert found[0]["size"] == 20 and found[0]["max_score"] == 259.0 and found[1]["mean_score"] == 269.5
