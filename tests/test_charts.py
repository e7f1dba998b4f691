import math

import numpy as np
import pytest
from conftest import subspace
from pyspark.sql import functions as F

from quietband.operators import charts, spectral
from quietband.operators.feature_graph import build_feature_graph


def _orthonormal(d, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


@pytest.mark.parametrize("seed", range(8))
def test_alignment_of_full_bases_differs_by_one_reflection_at_most(seed):
    local, reference = _orthonormal(6, seed), _orthonormal(6, seed + 100)
    found = charts.align_basis(local, np.arange(6.0), reference)
    assert np.allclose(found.rotation @ found.rotation.T, np.eye(6))
    assert np.linalg.det(found.rotation) == pytest.approx(1.0)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(6))
    gap = np.linalg.matrix_rank(found.vectors - reference, tol=1e-8)
    assert gap == 0 or gap == 1
    if gap == 0:
        assert found.score == pytest.approx(1.0)


def test_alignment_undoes_order_and_signs():
    reference = _orthonormal(5, 1)
    shuffled = reference[:, [3, 0, 4, 1, 2]] * np.array([1, -1, 1, -1, -1])
    found = charts.align_basis(shuffled, np.array([3.0, 0.0, 4.0, 1.0, 2.0]), reference)
    assert np.allclose(found.vectors, reference) and found.values.tolist() == [0, 1, 2, 3, 4]
    truncated = charts.align_basis(_orthonormal(6, 5)[:, :2], np.arange(2.0), _orthonormal(6, 6)[:, :2])
    assert truncated.score < 1.0


def test_selection_prefers_the_axes_that_carry_the_distances():
    rng = np.random.default_rng(0)
    rows = np.column_stack([rng.normal(size=(300, 2)), 0.01 * rng.normal(size=(300, 2))])
    assert sorted(charts.select_chart_basis(np.eye(4), rows, 2)) == [0, 1]
    assert charts.select_chart_basis(np.eye(4), rows[:1], 2) == [2, 3]


def test_injectivity_and_continuity_of_given_pairs(spark):
    rows = [(1, float(i), float(i**2)) for i in range(50)] + [(2, float(i), 1.0) for i in range(50)]
    pairs = spark.createDataFrame(rows, "chart_id int, ambient double, chart double")
    found = {r["chart_id"]: r["injectivity"] for r in charts.injectivity(pairs).collect()}
    assert found == pytest.approx({1: 1.0, 2: 0.0})
    torn = spark.createDataFrame(
        [(1, 1.0, 1.0)] * 60 + [(2, 1.0, 1.0)] * 60 + [(2, 1e-6, 1.0)] * 5, pairs.schema
    )
    ok = {r["chart_id"]: r["continuous"] for r in charts.continuity(torn).collect()}
    assert ok == {1: True, 2: False}


def test_primary_chart_overlaps_and_coverage(spark):
    points = spark.range(6)
    members = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3), (2, 2)], "chart_id int, id long")
    scores = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "chart_id int, alignment_score double")
    best = {r["id"]: r["chart_id"] for r in charts.primary_chart(points, members, scores, "id").collect()}
    assert best == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    shared = {tuple(r) for r in charts.chart_overlaps(members, "id").collect()}
    assert shared == {(0, 1, 2), (0, 2, 2), (1, 2, 2)}
    row = charts.coverage(points, members, "id").first()
    assert (row["covered"], row["points"], row["coverage"]) == (3, 6, 0.5)


def test_tangent_variation():
    flat, turned = np.eye(3)[:, :1], np.array([[math.cos(0.3)], [math.sin(0.3)], [0.0]])
    assert charts.tangent_variation([flat]) == 0.0
    assert charts.tangent_variation([flat, turned, turned]) == pytest.approx(0.15)


def test_expansion_takes_outside_neighbours_up_to_the_quota(spark, points):
    line = points(np.arange(40.0)[:, None] * [1.0, 0.0])
    core = line.select("id", (F.col("id") >= 20).cast("int").alias("unit"))
    pairs = charts.row_neighbors(line, "id", k=5)
    grown = charts.expand_region(core, pairs, "id", overlap=0.05)
    extra = {(r["unit"], r["id"]) for r in grown.where("role = 'boundary'").collect()}
    assert len(extra) == 2 and all((u == 0) == (i >= 20) for u, i in extra)
    assert all(16 <= i <= 23 for _, i in extra)
    assert grown.where("role = 'core'").count() == 40


@pytest.fixture(scope="module")
def plane(points):
    x = subspace(240, 5, 2, 0.03, 0)
    table = points((x - x.mean(axis=0)) / x.std(axis=0))
    return table, spectral.analyze_fourier(table, build_feature_graph(table))


def test_regions_are_a_partition(plane):
    _, spectrum = plane
    regions = charts.partition_regions(spectrum.coefficients, "id", 2, 3)
    assert regions.count() == 240 and regions.select("id").distinct().count() == 240
    numbers = sorted(r[0] for r in regions.select("region").distinct().collect())
    assert numbers == list(range(len(numbers)))
    assert charts.chart_count(50) == 2 and charts.chart_count(10**7) == 20 and charts.chart_count(90_000) == 20


def test_atlas_covers_a_plane(plane, spark):
    _, spectrum = plane
    found = charts.build_atlas(spectrum.coefficients, "id", spectrum, 4, n_charts=2)
    assert found.coverage.first()["coverage"] == 1.0 and not found.rejected
    assert found.assignments.count() == 240
    for chart in found.charts:
        assert chart.injectivity >= 0.8 and chart.basis.shape == (5, 4)
        assert np.allclose(chart.basis.T @ chart.basis, np.eye(4))
        assert chart.quality == "excellent" or chart.alignment_score < 0.95
    assert found.charts_df(spark).count() == len(found.charts)


def test_failing_regions_are_split_and_given_up(plane, monkeypatch):
    """One-dimensional charts of a plane fail the gate until the retries run out."""
    _, spectrum = plane
    regions = spectrum.coefficients.select("id", (F.col("id") % 2).cast("int").alias("region"))
    monkeypatch.setattr(charts, "INJECTIVITY_GATE", 0.999999)
    with pytest.raises(RuntimeError):
        charts.build_atlas(spectrum.coefficients, "id", spectrum, 1, max_retries=1, regions=regions)


def test_the_first_good_half_becomes_the_chart(plane, monkeypatch):
    _, spectrum = plane
    attempts = []
    accept = charts._AtlasBuilder._accept

    def once(self, row, basis, share):
        attempts.append(row["unit"])
        return None if row["unit"] == 0 else accept(self, row, basis, share)

    monkeypatch.setattr(charts._AtlasBuilder, "_accept", once)
    monkeypatch.setattr(charts, "INJECTIVITY_GATE", -1.0)
    regions = spectrum.coefficients.select("id", (F.col("id") % 2).cast("int").alias("region"))
    found = charts.build_atlas(spectrum.coefficients, "id", spectrum, 2, regions=regions)
    # One half may be too small for a chart of its own.
    assert attempts in ([0, 2, 1], [0, 3, 1]) and [c.unit for c in found.charts] == attempts[1:]
    covered = found.coverage.first()
    assert 120 < covered["covered"] < 240
    # Rows that were dropped with the other half go to the chart with the nearest mean.
    lost = found.assignments.join(found.members, "id", "left_anti").toPandas()
    rows = spectrum.coefficients.select("id", "features").toPandas().set_index("id").features
    chart = found.members.toPandas().set_index("id").chart_id
    means = {c: np.mean(np.stack(rows[chart.index[chart == c]]), axis=0) for c in set(chart)}
    for r in lost.itertuples():
        gaps = {c: np.linalg.norm(np.array(rows[r.id]) - m) for c, m in means.items()}
        assert gaps[r.chart_id] == min(gaps.values())
    assert len(lost) == 240 - covered["covered"]


def test_groups_are_halved_in_the_same_jobs(spark):
    rng = np.random.default_rng(9)
    rows, truth = [], {}
    for grp in range(3):
        for i in range(60):
            side = int(rng.integers(0, 2))
            truth[len(rows)] = (grp, side)
            point = rng.normal(size=4) * 0.3 + 5 * side * np.eye(4)[grp] + 10 * grp
            rows.append((len(rows), grp, point.tolist()))
    df = spark.createDataFrame(rows, "id long, unit int, features array<double>").repartition(5)
    found = charts.split_regions(df, "id", "unit").collect()
    assert all((r["unit"], r["half"]) == truth[r["id"]] for r in found) and len(found) == len(rows)
    alone = charts.split_region(df.where("unit = 1"), "id").collect()
    assert {r["half"] for r in alone} == {0, 1} and len(alone) == 60


def test_atlas_reads_the_lines_once_and_holds_no_pair_per_copy(spark, monkeypatch):
    from quietband.plans import catalog_scores, inputs

    read, searched = [], []
    table = inputs.table
    monkeypatch.setattr(inputs, "table", lambda s, sf, name: read.append(name) or table(s, sf, name))
    monkeypatch.setattr(charts, "row_neighbors", lambda *a, **k: searched.append(a))
    found = catalog_scores._atlas(spark, "/root/testdata/sf0.001")
    assert found.charts and sorted(read) == ["lineitem", "orders"] and not searched
