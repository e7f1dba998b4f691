import numpy as np
import pytest
from pyspark.sql import functions as F

from quietband.operators import spectral
from quietband.operators.feature_graph import build_feature_graph


@pytest.fixture(scope="module")
def power(spark):
    return lambda values: spark.createDataFrame(list(enumerate(map(float, values))), "k int, power double")


def _bands(frame):
    return [(r["start"], r["end"]) for r in frame.orderBy("band").collect()]


def test_transform_keeps_lengths_and_inverts(points):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6))
    table = points(x)
    basis = spectral.fit_basis(build_feature_graph(table).edges, 6)
    rotated = spectral.gft(table, basis)
    back = spectral.inverse_gft(rotated.drop("features"), basis).orderBy("id").collect()
    assert np.allclose([r["features"] for r in back], x)
    coeffs = np.array([r["coeffs"] for r in rotated.orderBy("id").collect()])
    assert np.allclose((coeffs**2).sum(axis=1), (x**2).sum(axis=1))
    some = spectral.gft_subset(table, F.col("id") < 5, basis)
    assert some.count() == 5


@pytest.mark.parametrize("d", [3, 80])
def test_mean_power_for_narrow_and_wide_tables(points, d):
    x = np.random.default_rng(1).normal(size=(40, d))
    x[:, 1] = 0.0
    rows = spectral.mean_power(points(x), "features").orderBy("k").collect()
    assert [r["power"] for r in rows] == pytest.approx((x**2).mean(axis=0).tolist())


def test_cumulative_dominant_and_centroid(spark, power):
    p = power([1, 4, 3, 2])
    shares = [r["cumulative"] for r in spectral.cumulative_power(p).orderBy("k").collect()]
    assert shares == pytest.approx([0.1, 0.5, 0.8, 1.0])
    assert [r["k"] for r in spectral.dominant_components(p, 2).collect()] == [1, 2]
    basis = spectral.Basis(np.array([0.0, 1.0, 2.0, 3.0]), np.eye(4)).to_df(spark)
    assert spectral.spectral_centroid(p, basis).first()[0] == pytest.approx(1.6)
    silent = power([0, 0, 0, 0])
    assert spectral.spectral_centroid(silent, basis).first()[0] == 0.0
    assert {r[1] for r in spectral.cumulative_power(silent).collect()} == {0.0}
    assert spectral.compare_spectra(p, power([1, 0, 0, 2])).first()[0] == pytest.approx(5.0)


def test_only_upward_jumps_are_gaps(power):
    gaps = spectral.spectral_gaps(power([1, 1, 50, 50, 1, 1]))
    assert [r["k"] for r in gaps.collect()] == [1]
    assert spectral.spectral_gaps(power([5])).isEmpty()
    assert spectral.spectral_gaps(power([1, 0, 0, 0])).isEmpty()


def test_band_layouts(spark, power):
    gaps = spectral.spectral_gaps(power([1, 1, 50, 50, 1, 1]))
    assert _bands(spectral.bands_from_gaps(gaps, 6)) == [(0, 1), (2, 5)]
    for d, n in [(10, 3), (7, 3), (5, 2), (2, 3), (1, 3), (64, 5)]:
        count = min(n, d)
        edges = [round(d * i / count) for i in range(count + 1)]
        bands = spectral.uniform_bands(spark, d, n)
        assert _bands(bands) == [(edges[i], edges[i + 1] - 1) for i in range(count)]
        assert spectral.validate_band_coverage(bands, d).first()["covered"]
    overlapping = spark.createDataFrame([(0, 0, 2), (1, 2, 3)], "band int, start int, end int")
    assert not spectral.validate_band_coverage(overlapping, 4).first()["covered"]


@pytest.mark.parametrize(
    "n,labels",
    [(1, "all"), (2, "dc noise"), (3, "dc mid noise"), (4, "dc low high noise"), (6, "dc low mid mid high noise")],
)
def test_band_labels(spark, n, labels):
    named = spectral.label_bands(spectral.uniform_bands(spark, 12, n)).orderBy("band").collect()
    assert [r["label"] for r in named] == labels.split()


def test_analysis_covers_the_spectrum_and_needs_a_graph(points):
    x = np.random.default_rng(2).normal(size=(50, 5)) * [1, 1, 9, 9, 9]
    table = points(x)
    found = spectral.analyze_fourier(table, build_feature_graph(table))
    assert found.bands[0][0] == 0 and found.bands[-1][1] == 4
    assert sum(b[3] for b in found.bands) == pytest.approx((x**2).sum())
    with pytest.raises(ValueError):
        spectral.analyze_fourier(table, None)
