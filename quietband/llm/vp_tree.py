"""Nearest neighbours by inner product with one vantage-point tree per shard.

An extra coordinate turns the largest inner product into the smallest distance:
with ``m`` the largest norm of a shard, ``x`` becomes ``(x, sqrt(m^2 - |x|^2))``
and a query ``(q, 0)``. Trees split at the median distance to a vantage point;
a half is skipped when ``factor`` times the distance of the k-th neighbour found
so far cannot reach it. Factor one is exact, smaller ones skip more. A task
searches one shard for one block of queries, so neither side must fit anywhere
as a whole; all queries of a block go down a tree together.

Equal vectors of a shard are one class, searched once and named by its smallest id.
The ``k`` best classes, by exact product and then by name, hold the ``k`` best rows
whatever ties there are; matrix kernels only tell which products are worth the exact sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietband.llm.vectors import matrix, usable

NEIGHBOURS = 20
# One loses no neighbour; 0.6 kept 0.72 of them on vectors of very different lengths.
FACTOR = 1.0
SHARD_ROWS = 16_384
MIN_SHARDS = 24
BLOCK_QUERIES = 4_096
LEAF = 128
# Pairs whose exact products are summed at once; units in the last place a rounded sum may be off per term.
PAIRS = 1 << 16
ROUNDING = 8 * np.finfo(np.float64).eps
# Name of a place not taken yet.
NONE = np.iinfo(np.int64).max


class VantageTree:
    def __init__(self, points: np.ndarray, seed: int = 3):
        self.points = points
        square = np.einsum("ij,ij->i", points, points)
        self.top = square.max() if len(points) else 0.0
        self.extra = np.sqrt(np.maximum(self.top - square, 0.0))
        # Name of each class, and the one it goes by where that is left out, unless it is alone.
        self.ids, self.others = np.arange(len(points)), np.arange(len(points))
        self.alone = np.ones(len(points), bool)
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = int(rows[self.rng.integers(len(rows))])
        product = self.points[rows] @ self.points[vantage] + self.extra[rows] * self.extra[vantage]
        distance = np.sqrt(np.maximum(2 * self.top - 2 * product, 0.0))
        radius = float(np.median(distance))
        inside = distance <= radius
        if inside.all():  # many equal distances: no split can help
            return rows
        return vantage, radius, self._grow(rows[inside]), self._grow(rows[~inside])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        """Rows and exact products of the ``k`` best of each query, ties to the smaller id.

        ``own[i]`` is the id to leave out: a class goes by its other id then, or not at all.
        """
        keep = max(1, min(k, len(self.points)))
        self.best = np.full((len(queries), keep), -np.inf)
        self.rows = np.full((len(queries), keep), -1)
        self.names = np.full((len(queries), keep), NONE)
        self.queries, self.own, self.factor = queries, own, factor
        self.square = np.einsum("ij,ij->i", queries, queries)
        terms = ROUNDING * (self.points.shape[1] + 4)
        self.unsure = terms * np.sqrt(self.square * self.top)
        self.blur = 4 * np.sqrt(terms * (self.square + self.top))
        self._visit(self.root, np.arange(len(queries)))
        return self.rows, self.best

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            return self._look(node, active)
        vantage, radius, inner, outer = node
        product = self.queries[active] @ self.points[vantage]
        distance = np.sqrt(np.maximum(self.square[active] + self.top - 2 * product, 0.0))
        near = distance <= radius
        self._visit(inner, active[near])
        self._visit(outer, active[~near])
        slack = self.factor * self._reach(active) + self.blur[active]
        self._visit(outer, active[near & (distance + slack >= radius)])
        slack = self.factor * self._reach(active) + self.blur[active]
        self._visit(inner, active[~near & (distance - slack <= radius)])

    def _reach(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th neighbour so far; endless while there are fewer."""
        return np.sqrt(np.maximum(self.square[active] + self.top - 2 * self.best[active, -1], 0.0))

    def _look(self, rows: np.ndarray, active: np.ndarray) -> None:
        for low in range(0, len(rows), LEAF):
            part = rows[low : low + LEAF]
            product = self.queries[active] @ self.points[part].T
            hopeful = product >= (self.best[active, -1] - self.unsure[active])[:, None]
            at, column = np.nonzero(hopeful)
            query, row = active[at], part[column]
            left_out = self.ids[row] == self.own[query]
            name = np.where(left_out, self.others[row], self.ids[row])
            kept = ~(left_out & self.alone[row])
            if kept.any():
                self._enter(query[kept], row[kept], name[kept])

    def _enter(self, query: np.ndarray, row: np.ndarray, name: np.ndarray) -> None:
        """Merge candidates, sorted by query, into the best of their queries."""
        exact = np.concatenate(
            [products(self.points[row[i : i + PAIRS]], self.queries[query[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]
        )
        touched, first, sizes = np.unique(query, return_index=True, return_counts=True)
        line = np.repeat(np.arange(len(touched)), sizes)
        keep = self.best.shape[1]
        place = keep + np.arange(len(row)) - np.repeat(first, sizes)
        wide = (len(touched), keep + int(sizes.max()))
        best, rows, names = np.full(wide, -np.inf), np.full(wide, -1), np.full(wide, NONE)
        for all_, held, new in ((best, self.best, exact), (rows, self.rows, row), (names, self.names, name)):
            all_[:, :keep] = held[touched]
            all_[line, place] = new
        top = np.lexsort((names, -best), axis=1)[:, :keep]
        for all_, held in ((best, self.best), (rows, self.rows), (names, self.names)):
            held[touched] = np.take_along_axis(all_, top, axis=1)


def products(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same sum for equal vectors wherever they lie."""
    return (points * queries).sum(axis=1)


def classes(ids: np.ndarray, points: np.ndarray, k: int):
    """Distinct vectors, and the ids of each: ``(points, ids, starts)``, ids sorted within a class.

    The ``k + 1`` smallest ids are kept, each as often as it occurs but ``k`` times at most:
    enough for the ``k`` best whatever id is left out. Order follows ids and vectors alone.
    """
    points = points + 0.0  # one zero
    raw = np.ascontiguousarray(points).view(np.dtype((np.void, points.shape[1] * 8))).ravel()
    _, first, label = np.unique(raw, return_index=True, return_inverse=True)
    least = np.full(len(first), NONE)
    np.minimum.at(least, label, ids)
    turn = np.argsort(least, kind="stable")
    place = np.empty(len(turn), np.int64)
    place[turn] = np.arange(len(turn))
    label, first = place[label], first[turn]
    order = np.lexsort((ids, label))
    label, ids = label[order], ids[order]
    at = np.arange(len(ids))
    new_class = np.append(True, label[1:] != label[:-1])
    new_id = new_class | np.append(True, ids[1:] != ids[:-1])
    since = lambda new: np.maximum.accumulate(np.where(new, at, 0))
    rank = np.cumsum(new_id)
    kept = (rank - rank[since(new_class)] <= k) & (at - since(new_id) < k)
    return points[first], ids[kept], np.searchsorted(label[kept], np.arange(len(first) + 1))


def _search(k: int, factor: float):
    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        names = ["query_id", "ids", "scores"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        if not shard.num_rows or not block.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids, owners = shard["id"].to_numpy(), block["id"].to_numpy()
        points, queries = matrix(shard["vector"]), matrix(block["vector"])
        points, members, starts = classes(ids, points, k)
        tree = VantageTree(points)
        tree.ids, last = members[starts[:-1]], members[starts[1:] - 1]
        one = np.repeat(tree.ids, np.diff(starts)) == members
        other = starts[:-1] + np.add.reduceat(one.astype(np.int64), starts[:-1])
        tree.alone = tree.ids == last
        tree.others = members[np.minimum(other, len(members) - 1)]
        rows, best = tree.search(queries, owners, k, factor)
        found_ids, scores = [], []
        for at, product, own in zip(rows, best, owners):
            at, product = at[at >= 0], product[at >= 0]
            near = np.concatenate([members[:0], *[members[starts[c] : starts[c + 1]] for c in at]])
            exact = np.repeat(product, starts[at + 1] - starts[at])
            near, exact = near[near != own], exact[near != own]
            order = np.lexsort((near, -exact))[:k]
            found_ids.append(near[order])
            scores.append(exact[order])
        arrays = [pa.array(owners), pa.array(found_ids, kinds[1]), pa.array(scores, kinds[2])]
        return pa.table(arrays, names=names)

    return search


def nearest(
    table: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEIGHBOURS,
    factor: float = FACTOR,
) -> DataFrame:
    """``(query_id, rank, id, score)``: for rows where ``queries`` holds, the ``k`` largest products.

    Candidates are all rows with another id; ties go to the smaller id. Vectors that
    are NULL, zero or not finite and rows with a NULL id take no part, vectors must
    have one length. Queries that repeat an id are asked once.
    """
    kept = table.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    ).where(usable("vector") & F.col("id").isNotNull())
    total = table.count()
    shards = max(MIN_SHARDS, -(-total // SHARD_ROWS))
    blocks = max(1, -(-table.where(queries).count() // BLOCK_QUERIES))
    points = kept.select(
        "id", "vector", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).alias("shard")
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = (
        kept.where("asks")
        .dropDuplicates(["id"])
        .select("id", "vector", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    )
    found = (
        points.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(_search(k, factor), "query_id long, ids array<long>, scores array<double>")
    )
    each = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "query_id", F.col("x.ids").alias(id_col), F.col("x.scores").alias("score")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", id_col, "score"
    )
