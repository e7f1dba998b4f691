"""Joins and searches against brute force."""

import random
import re
import string

import numpy as np
import pytest

from quietband.llm import jaccard_join, near_vectors, vp_tree
from quietband.llm.jaccard_join import jaccard_components
from quietband.llm.near_vectors import collision, table_shape
from quietband.llm.vp_tree import nearest

UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.randint(20, 120))] + passage * (family % 2)
        for _ in range(rng.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, " \n\t", "a b", "A B", "a b c", "Ä ö", "ä ö", "x y z v w", "x y z v w " * 4000]
    rows += [rows[3]] * 20
    return list(enumerate(rows))


@pytest.mark.parametrize("tile, frequent", [(256, 8), (7, 3)])
def test_jaccard_components(spark, texts, monkeypatch, tile, frequent):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", frequent)
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key")
    sets = {i: shingles(t) for i, t in texts}
    alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and sets[i]
    truth = components([i for i, _ in texts], alike)
    found = jaccard_components(docs.repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == truth
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in sets.items()}
    assert len(found) == len(texts)


def test_texts_of_frequent_shingles_only(spark):
    """A passage of many long texts that also stands alone, whole and without its last words."""
    passage = [f"p{i}" for i in range(40)]
    rows = [" ".join([f"w{d}x{i}" for i in range(200)] + passage) for d in range(30)]
    rows += [" ".join(passage), " ".join(passage[:-3])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    assert found == {**{d: d for d in range(31)}, 31: 30}


def test_overlaps_of_empty_sets():
    none = np.zeros(0, np.uint64)
    assert jaccard_join.overlaps([none, none]).tolist() == [[0, 0], [0, 0]]
    assert jaccard_join.overlaps([none, np.arange(3, dtype=np.uint64)]).tolist() == [[0, 0], [0, 0]]


def test_jaccard_without_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(none).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "a b"), (4, "a b"), (4, "a b")], none.schema)
    rows = sorted(map(tuple, jaccard_components(odd).collect()), key=str)
    assert rows == sorted([(None, 0, None), (None, 1, 4), (4, 1, 4), (4, 1, 4)], key=str)


def vectors():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(120, 16))
    points[40:80] = points[3] + rng.normal(size=(40, 16)) * 0.08
    points[80:100] = points[5]
    points[100:110] = points[6] * np.linspace(1, 9, 10)[:, None]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    return rows + [(120 + i, b) for i, b in enumerate(bad)]


@pytest.mark.parametrize("tile", [256, 6])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    rows = vectors()
    points = {i: np.array(v) for i, v in rows if i < 120}
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    alike = lambda i, j: i in points and j in points and cosine(points[i], points[j]) >= 0.95
    truth = components([i for i, _ in rows], alike)
    links = {i: sum(alike(i, j) for j in points if j != i) for i, _ in rows}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as copies")
    found = near_vectors.near_vectors(table).collect()
    assert len(found) == len(rows)
    close = sum(r["n_links"] for r in found) / sum(links.values())
    assert 0.97 <= close <= 1 and all(r["n_links"] <= links[r["vec_id"]] for r in found)
    assert {r["vec_id"]: r["component_id"] for r in found} == truth
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_hash_tables_follow_the_number_of_vectors():
    assert table_shape(10) < table_shape(10_000) < table_shape(10**9)
    assert 0 < collision(1.4) < collision(0.3) < 1


@pytest.mark.parametrize("leaf", [128, 4])
def test_exact_search_with_factor_one(spark, monkeypatch, leaf):
    monkeypatch.setattr(vp_tree, "LEAF", leaf)
    rows = [r for r in vectors() if r[1] is None or len(r[1]) == 16] + [(300, vectors()[80][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score")
    found = nearest(table, table.vec_id % 20 == 0, k=20, factor=1.0).collect()
    good = {i: np.array(v) for i, v in rows if i < 120 or i == 300}
    for q in [i for i in good if i % 20 == 0]:
        score = {i: float((v * good[q]).sum()) for i, v in good.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == best and [r["rank"] for r in mine] == list(range(1, 21))
        assert np.allclose([r["score"] for r in mine], [score[i] for i in best], rtol=1e-12)
    assert {r["query_id"] for r in found} == {i for i in good if i % 20 == 0}


@pytest.mark.parametrize("factor", [1.0, vp_tree.FACTOR])
def test_many_copies_of_one_vector_go_by_id(spark, factor):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(1300, 8))
    points[rng.permutation(1300)[:1000]] = np.full(8, 3.0)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(1300, rows[0][1])] * 3  # an id may repeat
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = nearest(table, table.vec_id % 100 == 0, k=20, factor=factor).collect()
    for q in range(0, 1301, 100):
        score = [(-float((np.array(v) * np.array(rows[q][1])).sum()), i) for i, v in rows if i != q]
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        truth = [i for _, i in sorted(score)[:20]]
        near = sum(x == y for x, y in zip(truth, [r["vec_id"] for r in mine])) / 20
        same = np.ptp([s for s, _ in sorted(score)[:20]]) == 0  # all of them copies
        assert near == 1 if factor == 1 or same else len(mine) == 20


def test_ties_of_distinct_vectors_go_to_smaller_ids():
    rng = np.random.default_rng(9)
    points = np.unique([rng.permutation(8) + 1.0 for _ in range(3000)], axis=0)
    points = points[rng.permutation(len(points))]
    tree = vp_tree.VantageTree(points)
    rows, best = tree.search(np.ones((3, 8)), np.array([0, 5, -1]), 20, 1.0)
    assert (best == 36).all()
    assert rows.tolist() == [[*range(1, 21)], [i for i in range(21) if i != 5], [*range(20)]]


def test_search_with_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest(table, table.vec_id % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert nearest(table.limit(0), table.vec_id == 0).count() == 0


@pytest.mark.parametrize("kind", ["unit", "clustered", "skewed"])
def test_recall_of_full_shards(kind):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(vp_tree.SHARD_ROWS, 64))
    if kind == "clustered":
        points = rng.normal(size=(40, 64))[rng.integers(0, 40, len(points))] + 0.2 * points
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    if kind == "skewed":
        points *= rng.lognormal(0, 1, (len(points), 1))
    asked = np.arange(0, len(points), 200)
    tree = vp_tree.VantageTree(points)
    rows, _ = tree.search(points[asked], asked, 20, vp_tree.FACTOR)
    product = points[asked] @ points.T
    product[np.arange(len(asked)), asked] = -np.inf
    truth = np.argsort(-product, axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(rows, truth)])
    assert recall == 1
