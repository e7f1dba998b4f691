import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietband.functions import smallmath
from quietband.operators import feature_graph as fg
from quietband.operators import mutual_information as pair_counts
from quietband.operators import graph, spectral


@pytest.fixture(scope="module")
def edges(spark):
    return lambda rows: spark.createDataFrame([(i, j, float(w)) for i, j, w in rows], "i long, j long, weight double")


@pytest.fixture(scope="module")
def nodes(spark):
    return lambda n: spark.range(n).withColumnRenamed("id", "node")


COMPLETE = [(i, j, 1) for i in range(4) for j in range(i + 1, 4)]
PATH = [(0, 1, 1), (1, 2, 1), (2, 3, 1)]


def test_spectra_of_complete_and_path_graphs(edges):
    assert spectral.fit_basis(edges(COMPLETE), 4).values == pytest.approx([0, 4, 4, 4], abs=1e-9)
    path = spectral.fit_basis(edges(PATH), 4)
    assert path.values == pytest.approx([0, 2 - math.sqrt(2), 2, 2 + math.sqrt(2)], abs=1e-9)
    assert np.allclose(path.vectors.T @ path.vectors, np.eye(4))
    assert spectral.fit_basis(edges(PATH), 4, 2).vectors.shape == (4, 2)
    normalized = spectral.fit_basis(edges(COMPLETE), 4, normalized=True)
    assert normalized.values == pytest.approx([0, 4 / 3, 4 / 3, 4 / 3], abs=1e-9)


def test_components_of_long_chains_and_hubs(spark, edges, nodes):
    chain = [(i, i + 1, 1) for i in range(300)]
    hub = [(1000, 1001 + i, 1) for i in range(500)]
    found = graph.connected_components(edges(chain + hub + [(5000, 5001, 0)]))
    sizes = {r["component"]: r["count"] for r in found.groupBy("component").count().collect()}
    assert sizes == {0: 301, 1000: 501}
    alone = graph.connected_components(edges([(0, 1, 1)]), nodes(4)).orderBy("node").collect()
    assert [r["component"] for r in alone] == [0, 0, 2, 3]


def test_components_of_random_graphs_match_union_find(spark, edges):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b), 1) for a, b in rng.integers(0, 200, (150, 2)) if a != b]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    for r in graph.connected_components(edges(pairs)).collect():
        assert r["component"] == root(r["node"])


def _floyd(n, rows):
    dist = np.full((n, n), np.inf)
    np.fill_diagonal(dist, 0)
    for i, j, w in rows:
        dist[i, j] = dist[j, i] = min(dist[i, j], w)
    for k in range(n):
        dist = np.minimum(dist, dist[:, [k]] + dist[[k], :])
    return dist


def test_paths_and_diameter_match_brute_force(edges, nodes):
    rng = np.random.default_rng(4)
    rows = [(i, i + 1, float(rng.integers(1, 9))) for i in range(29)]
    rows += [(int(a), int(b), float(rng.integers(1, 20))) for a, b in rng.integers(0, 30, (15, 2)) if b > a + 1]
    unique = list({(a, b): (a, b, w) for a, b, w in rows}.values())
    truth = _floyd(30, unique)
    found = graph.shortest_paths(edges(unique), nodes(30), 7).orderBy("node").collect()
    assert [r["distance"] for r in found] == pytest.approx(truth[7].tolist())
    assert graph.graph_diameter(edges(unique), nodes(30), sources_per_round=3) == truth.max()
    assert graph.graph_diameter(edges(PATH), nodes(5)) == math.inf
    far = graph.shortest_paths(edges(PATH), nodes(5), 0).where("node = 4").first()
    assert far["distance"] == math.inf


def test_clustering_coefficient_matches_matrix_formula(edges, nodes):
    rng = np.random.default_rng(5)
    a = np.triu(rng.random((25, 25)) < 0.3, 1)
    a[0, 1:] = True  # a hub
    rows = [(int(i), int(j), 2) for i, j in zip(*np.nonzero(a))]
    b = (a | a.T).astype(float)
    k = b.sum(axis=1)
    truth = np.divide(np.diag(b @ b @ b), k * (k - 1), out=np.zeros(25), where=k > 1)
    value = graph.clustering_coefficient(edges(rows), nodes(27)).first()[0]
    assert value == pytest.approx(truth.sum() / 27)


def test_laplacians_have_zero_row_sums_and_unit_diagonal(edges, nodes):
    rows = graph.laplacian(edges(PATH), nodes(5)).groupBy("i").agg(F.sum("value").alias("s")).collect()
    assert len(rows) == 5 and all(abs(r["s"]) < 1e-12 for r in rows)
    diagonal = {r["i"]: r["value"] for r in graph.normalized_laplacian(edges(PATH), nodes(5)).where("i = j").collect()}
    assert diagonal == pytest.approx({0: 1, 1: 1, 2: 1, 3: 1, 4: 0})


def test_validate_graph_reports_each_defect(edges):
    bad = fg.validate_graph(edges([(0, 1, 1), (1, 0, 2), (2, 2, 1), (3, 4, -1), (4, 3, -1)])).first()
    assert (bad["symmetric"], bad["non_negative"], bad["zero_diagonal"]) == (False, False, False)


def _pairs(frame):
    return {(r["i"], r["j"]): r["weight"] for r in frame.collect()}


def test_correlation_and_partial_correlation_match_numpy(points):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    x[:, 1] += x[:, 0]
    x[:, 3] = 2.0
    corr = _pairs(fg.correlation_edges(points(x)))
    assert corr[0, 1] == pytest.approx(abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]))
    assert corr[0, 3] == 0.0
    partial = _pairs(fg.partial_correlation_edges(points(x[:, :3]), method="inverse"))
    p = np.linalg.inv(np.cov(x[:, :3].T))
    assert partial[0, 2] == pytest.approx(abs(p[0, 2]) / math.sqrt(p[0, 0] * p[2, 2]))


def test_information_ranks_dependent_pairs_first(points):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 3))
    x = np.column_stack([base, base**2 + 0.05 * rng.normal(size=(400, 3))])
    mi = _pairs(fg.mutual_information_edges(points(x)))
    dependent = [mi[i, i + 3] for i in range(3)]
    assert min(dependent) > 3 * max(w for e, w in mi.items() if e[1] != e[0] + 3)
    assert max(mi.values()) == pytest.approx(1.0)


def test_graph_of_three_correlated_pairs(points):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(80, 3))
    x = np.repeat(base, 2, axis=1) + 0.05 * rng.normal(size=(80, 6))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    built = fg.build_feature_graph(points(x))
    assert set(_pairs(built.edges)) == {(0, 1), (2, 3), (4, 5)}
    stats = built.stats.first()
    assert (stats["n_edges"], stats["n_components"], stats["avg_degree"]) == (3, 3, 1.0)


def test_regional_graphs_equal_graphs_of_the_parts(points):
    rng = np.random.default_rng(9)
    rows = points(rng.normal(size=(200, 3))).withColumn("g", (F.col("id") % 2).cast("int"))
    both = fg.correlation_edges(rows, by="g").where("g = 1").drop("g")
    alone = fg.correlation_edges(rows.where("g = 1"))
    assert _pairs(both) == pytest.approx(_pairs(alone))


def test_threshold_keeps_equal_weights(edges):
    rows = edges([(0, 1, 1), (0, 2, 1), (1, 2, 1)])
    assert fg.threshold_graph(rows, fg.adaptive_edge_threshold(rows)).count() == 3
    assert fg.threshold_graph(rows, 1.5).count() == 0


def test_tiles_of_columns_count_like_one_task(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 20))
    x[:, 1] += x[:, 0]
    rows = [(i % 2, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "grp long, vec array<double>").repartition(5)
    cuts = np.quantile(x, [k / 4 for k in range(1, 4)], axis=0).T
    monkeypatch.setattr(pair_counts, "BLOCK_ROWS", 128)
    monkeypatch.setattr(pair_counts, "CHUNK_BLOCKS", 2)
    found = pair_counts.joint_information(df, 20, 4, lambda grp: cuts, tile=7).toPandas()
    assert len(found) == 2 * 190
    code = np.column_stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)])
    for row in found.itertuples():
        a, b = code[row.grp :: 2, row.i], code[row.grp :: 2, row.j]
        joint = np.zeros((4, 4))
        np.add.at(joint, (a, b), 1 / len(a))
        outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        truth = (joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum()
        assert row.mi == pytest.approx(truth, abs=1e-12)


def test_lasso_by_blocks_is_the_lasso_of_the_whole(points):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 12))
    x[:, 1:3] += x[:, :1]
    x[:, 6:9] += 2 * x[:, 5:6]
    x = (x - x.mean(0)) / x.std(0)
    cov, penalty = x.T @ x / len(x), 0.2
    labels = smallmath.component_labels(np.abs(cov) > penalty)
    assert labels.max() + 1 > 4
    whole = smallmath.sparse_precision(cov, penalty, rounds=20000, tolerance=1e-10)
    scale = np.sqrt(np.diag(whole))
    found = fg.partial_correlation_edges(points(x), penalty=penalty).collect()
    assert len(found) == 66
    for r in found:
        assert r["weight"] == pytest.approx(abs(whole[r["i"], r["j"]]) / scale[r["i"]] / scale[r["j"]], abs=1e-5)


def test_adjacency_is_checked_in_one_grouping(spark):
    """Every kind of flaw is seen, and no join of the table with itself is needed."""
    good = [(1, 2, 0.5), (2, 1, 0.5), (2, 3, 1.0), (3, 2, 1.0)]
    cases = [
        ([], (True, True, True)),
        ([(4, 5, 1.0)], (False, True, True)),
        ([(5, 4, 1.0)], (False, True, True)),
        ([(4, 5, 1.0), (5, 4, 2.0)], (False, True, True)),
        ([(4, 5, -1.0), (5, 4, -1.0)], (True, False, True)),
        ([(4, 4, 1.0)], (True, True, False)),
        ([(4, 5, None)], (True, True, True)),
        ([(None, 5, 1.0)], (False, True, True)),
    ]
    for more, expected in cases:
        found = fg.validate_graph(spark.createDataFrame(good + more, "i long, j long, weight double"))
        assert tuple(found.first()) == expected, more
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_triangles_send_only_the_rest_of_a_list(spark, monkeypatch):
    """Around a complete graph every triangle counts once at each of its nodes."""
    edges = [(i, j, 1.0) for i in range(7) for j in range(i)] + [(6, 9, 1.0), (9, 10, 1.0)]
    table = spark.createDataFrame(edges, "i long, j long, weight double")
    kept = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    found = graph.clustering_coefficient(table).first()[0]
    assert found == pytest.approx((6 * 1.0 + 15 / 21 + 0 + 0) / 9)
    assert kept[-1] == ["a", "out"]


def test_large_steps_leave_no_shuffle_files(spark, edges, monkeypatch):
    modes = []
    cut = graph.cut_lineage
    mode = lambda df: df._jdf.queryExecution().shuffleCleanupMode().toString()
    monkeypatch.setattr(graph, "cut_lineage", lambda df: modes.append(mode(df)) or cut(df))
    found = graph.clustering_coefficient(edges([(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1)]))
    assert len(modes) == 3 and set(modes) == {"RemoveShuffleFiles"}
    assert "RemoveShuffleFiles" not in (mode(found), mode(spark.range(1)))
    assert found.first()[0] == pytest.approx((1 + 1 + 1 / 3 + 0) / 4)
