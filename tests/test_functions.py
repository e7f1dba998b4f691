import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietband.functions import quantiles, ranks, sampling, smallmath, vectors


@pytest.mark.parametrize("k", [1, 2, 4, 6])
def test_best_matching_equals_brute_force(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        gain = rng.normal(size=(k, k))
        chosen = smallmath.best_matching(gain)
        assert sorted(chosen) == list(range(k))
        best = max(sum(gain[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
        assert gain[np.arange(k), chosen].sum() == pytest.approx(best)


def test_ranks_share_ties_and_spearman_follows_order():
    assert smallmath.average_ranks(np.array([3.0, 1.0, 3.0, 2.0])).tolist() == [3.5, 1.0, 3.5, 2.0]
    x = np.arange(20.0)
    assert smallmath.spearman(x, x**3) == pytest.approx(1.0)
    assert smallmath.spearman(x, np.ones(20)) == 0.0


def test_sparse_precision_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    x[:, 1] += x[:, 0]
    cov, penalty = np.cov(x.T, ddof=0), 0.05
    precision = smallmath.sparse_precision(cov, penalty)
    gap = np.linalg.inv(precision) - cov
    off = ~np.eye(6, dtype=bool)
    assert np.abs(np.diag(gap)).max() < 1e-4
    assert np.abs(gap[off]).max() <= penalty + 1e-4
    active = off & (np.abs(precision) > 1e-8)
    assert np.allclose(gap[active], penalty * np.sign(precision[active]), atol=1e-4)


def test_component_count():
    linked = np.zeros((5, 5), dtype=bool)
    linked[0, 1] = linked[1, 0] = linked[3, 4] = linked[4, 3] = True
    assert smallmath.component_count(linked) == 3


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=30_001), np.full(15_000, 0.25), [1e10, -1e10]])
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(8)
    return values, rows.union(spark.createDataFrame([(None,), (float("nan"),)], "x double"))


@pytest.mark.parametrize("bound", [20_000, 300])
def test_exact_quantiles_on_heavy_ties_and_outliers(skewed, monkeypatch, bound):
    values, rows = skewed
    monkeypatch.setattr(quantiles, "MAX_BRACKET_ROWS", bound)
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    found = quantiles.exact_quantiles(rows, {"x": F.col("x"), "a": F.abs("x")}, probs)
    assert found["x"] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)
    assert found["a"] == pytest.approx(np.quantile(np.abs(values), probs).tolist(), rel=1e-12)


def test_quantiles_of_nothing_and_approximation(spark, skewed):
    empty = spark.createDataFrame([], "x double")
    assert quantiles.exact_quantiles(empty, {"x": F.col("x")}, [0.5]) == {"x": [None]}
    values, rows = skewed
    near = quantiles.approx_quantiles(rows, {"x": F.col("x")}, [0.1])["x"][0]
    assert abs((values < near).mean() - 0.1) < 0.001


def test_quota_and_first_per_group_with_one_hot_group(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 < 2, 0).otherwise(1).alias("g"), F.lit(150).alias("quota")
    )
    taken = sampling.quota_per_group(rows, "g", "id", "quota")
    assert {r["g"]: r["count"] for r in taken.groupBy("g").count().collect()} == {0: 150, 1: 150}
    again = sampling.quota_per_group(rows.repartition(7), "g", "id", "quota")
    assert sorted(r["id"] for r in taken.collect()) == sorted(r["id"] for r in again.collect())
    few = sampling.first_per_group(rows, ["g"], ["id"], 2).collect()
    assert sorted((r["g"], r["id"]) for r in few) == [(0, 0), (0, 1), (1, 2), (1, 5)]
    # A quota above the group's size takes all of it.
    small = rows.withColumn("quota", F.lit(10**6))
    assert sampling.quota_per_group(small, "g", "id", "quota").count() == 3000


@pytest.mark.parametrize("limit", [0, 10_000])
def test_matmul_unrolled_and_arrow_agree(points, monkeypatch, limit):
    monkeypatch.setattr(vectors, "MAX_UNROLLED_ENTRIES", limit)
    rng = np.random.default_rng(2)
    x, m = rng.normal(size=(50, 6)), rng.normal(size=(6, 4))
    rows = points(x).select("id", vectors.matmul(F.col("features"), m).alias("y")).orderBy("id")
    assert np.allclose([r["y"] for r in rows.collect()], x @ m)


def test_normalize_and_projections(points):
    x = np.array([[3.0, 4.0, 0.0], [0.0, 0.0, 0.0]])
    basis = np.array([[1.0], [0.0], [0.0]])
    row = F.col("features")
    out = points(x).select(
        "id",
        vectors.l2_normalize(row).alias("unit"),
        vectors.tangent_projection(row, basis).alias("t"),
        vectors.normal_projection(row, basis).alias("n"),
        vectors.normal_projection(row, np.eye(3)).alias("none"),
    ).orderBy("id").collect()
    assert out[0]["unit"] == pytest.approx([0.6, 0.8, 0.0]) and out[1]["unit"] == [0.0, 0.0, 0.0]
    assert out[0]["t"] == pytest.approx([3.0, 0.0, 0.0])
    assert out[0]["n"] == pytest.approx([0.0, 4.0, 0.0])
    assert out[0]["none"] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("values", [[0, 1], [0, 0, 0, 1], [1, 2, 5], [-1.5, -1.5, 7, 7, 7, 9], [3]])
def test_exact_quantiles_end_on_few_values(spark, monkeypatch, values):
    monkeypatch.setattr(quantiles, "MAX_BRACKET_ROWS", 50)
    rows = spark.range(0, 12_000, 1, 4).select(
        F.element_at(F.array(*map(F.lit, map(float, values))), (F.col("id") % len(values) + 1).cast("int")).alias("x")
    )
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    full = np.sort(np.resize(np.array(values, float), 12_000))
    found = quantiles.exact_quantiles(rows, {"x": F.col("x")}, probs)["x"]
    assert np.allclose(found, np.quantile(full, probs))


@pytest.mark.parametrize("shuffles", ["3", "40"])
def test_ranks_of_groups_over_many_ranges(spark, shuffles):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 600), rng.integers(0, 90, 600))]
    rows += [(7, -0.0), (7, 0.0), (7, float("nan")), (7, None)] + [(1, 5.0)] * 300
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    saved = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        found = ranks.average_ranks(df, "g", "v", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", saved)
    assert len(found) == len(rows)
    for grp in (0, 1, 2):
        values = np.array([v for g, v in rows if g == grp])
        truth = dict(zip(values.tolist(), smallmath.average_ranks(values)))
        assert all(r["rank"] == truth[r["v"]] for r in found if r["g"] == grp)
    assert sorted((r["rank"] for r in found if r["g"] == 7), key=str) == [1.5, 1.5, None, None]
