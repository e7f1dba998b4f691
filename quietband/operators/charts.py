"""Local linear charts: regions of similar rows, each with its own subspace.

Charts, bases and scores are tables of at most a few dozen rows; everything
with one row per point stays in Spark. Quality checks use a fixed number of
sampled points per region, chosen by hash so that runs repeat.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietband.functions import smallmath
from quietband.functions.partials import partial_sums
from quietband.functions.quantiles import exact_quantiles
from quietband.functions.ranks import rank_correlation
from quietband.functions.sampling import first_per_group, hash_order, quota_per_group
from quietband.functions.vectors import to_matrix
from quietband.operators import neighbors
from quietband.operators.feature_graph import build_edges, width_of
from quietband.operators.scoring import tangent_share
from quietband.operators.spectral import Spectrum
from quietband.session import check_broadcast, cut_lineage

MAX_CHARTS = 20
OVERLAP_NEIGHBORS = 10
SAMPLE_POINTS = 1000
SAMPLE_PAIRS = 500
PROXY_PAIRS = 200
CONTINUITY_POINTS = 50
MAX_SWAPS = 10
INJECTIVITY_GATE = 0.8
CONTINUITY_FACTOR = 100.0
TANGENT_LIMIT = 0.1
DIVERGENT_SCORE = 0.5
MIN_CHART_ROWS = 4
MIN_SPLIT_ROWS = 8
SPLIT_ROUNDS = 10
SPLIT_TOLERANCE = 1e-3


@dataclass(frozen=True)
class AlignedBasis:
    vectors: np.ndarray
    values: np.ndarray
    rotation: np.ndarray
    score: float


@dataclass(frozen=True)
class Chart:
    """One accepted chart; ``unit`` names the rows it was built from."""

    chart_id: int
    unit: int
    basis: np.ndarray
    aligned: np.ndarray
    alignment_score: float
    quality: str
    selected: list[int]
    injectivity: float
    distortion: float
    score: float


@dataclass
class Atlas:
    charts: list[Chart]
    members: DataFrame
    assignments: DataFrame
    coverage: DataFrame
    rejected: list[int] = field(default_factory=list)

    @property
    def bases(self) -> dict[int, np.ndarray]:
        return {c.chart_id: c.basis for c in self.charts}

    def charts_df(self, spark) -> DataFrame:
        rows = [
            (
                c.chart_id,
                c.unit,
                [[float(x) for x in row] for row in c.basis.T],
                c.alignment_score,
                c.quality,
                c.selected,
                c.injectivity,
                c.distortion,
                c.score,
            )
            for c in self.charts
        ]
        return spark.createDataFrame(
            rows,
            "chart_id int, unit int, basis array<array<double>>, alignment_score double, "
            "quality string, selected array<int>, injectivity double, distortion double, score double",
        )


# --- regions -----------------------------------------------------------------------


def chart_count(n: int, n_charts="auto") -> int:
    if n_charts == "auto":
        return min(MAX_CHARTS, max(2, int(math.sqrt(n / 100))))
    return max(2, int(n_charts))


def partition_regions(
    points: DataFrame,
    id_col: str,
    intrinsic_dim: int,
    n_charts="auto",
    coeffs: str = "coeffs",
    seed: int = 0,
) -> DataFrame:
    """``(id, region)`` by k-means on the low-frequency coefficients.

    Regions are numbered 0.. without holes.
    """
    low = points.select(
        id_col, array_to_vector(F.slice(coeffs, 1, 2 * intrinsic_dim)).alias("v")
    ).persist()
    try:
        k = chart_count(low.count(), n_charts)
        model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(low)
    finally:
        low.unpersist()
    found = model.transform(low).select(id_col, "cluster")
    used = sorted(r["cluster"] for r in found.select("cluster").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, used)), F.col("cluster")) - 1
    return found.select(id_col, number.cast("int").alias("region"))


def split_region(points: DataFrame, id_col: str, column: str = "features") -> DataFrame:
    """``(id, half)`` by 2-means; used on the rows of a region that failed."""
    return split_regions(points.withColumn("_all", F.lit(0)), id_col, "_all", column).select(id_col, "half")


def split_regions(points: DataFrame, id_col: str, by: str, column: str = "features") -> DataFrame:
    """``(id, by, half)`` by 2-means within each group, all groups in the same few jobs.

    Halves start at the mean plus and minus the spread along the column that varies most,
    so that runs repeat. ``points`` is read once per round; groups are few.
    """
    d = width_of(points, column)
    keyed = points.select(id_col, F.col(by).cast("long").alias(by), F.col(column).alias("_v"))

    def moments_of(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([rows.sum(0), (rows**2).sum(0), [len(rows)]])

    centres = {}
    for grp, total in _totals(partial_sums(keyed, "_v", 2 * d + 1, moments_of, by), 2 * d + 1).items():
        mean = total[:d] / total[-1]
        spread = np.sqrt(np.maximum(total[d : 2 * d] / total[-1] - mean**2, 0))
        step = np.where(np.arange(d) == spread.argmax(), spread, 0)
        centres[grp] = np.stack([mean - step, mean + step])
    check_broadcast(2 * len(centres), 8 * d, "the centres of halves")

    def gather(rows: np.ndarray, pair: np.ndarray) -> np.ndarray:
        half = _nearer(rows, pair)
        return np.concatenate([[(half == h).sum(), *rows[half == h].sum(0)] for h in (0, 1)])

    for _ in range(SPLIT_ROUNDS):
        moved = 0.0
        sums = _totals(partial_sums(keyed, "_v", 2 * d + 2, gather, by, centres), 2 * d + 2)
        for grp, total in sums.items():
            for h, part in enumerate(total.reshape(2, d + 1)):
                if part[0]:
                    moved = max(moved, float(np.abs(part[1:] / part[0] - centres[grp][h]).max()))
                    centres[grp][h] = part[1:] / part[0]
        if moved < SPLIT_TOLERANCE:
            break

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                groups, rows = batch.column(1).to_numpy(), to_matrix(batch.column(2))
                half = np.zeros(len(rows), np.int32)
                for grp in np.unique(groups):
                    mine = groups == grp
                    half[mine] = _nearer(rows[mine], centres[int(grp)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(half)], names=[id_col, by, "half"])

    kind = points.schema[id_col].dataType.simpleString()
    return keyed.mapInArrow(place, f"{id_col} {kind}, {by} long, half int")


def _nearer(rows: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """0 or 1: the centre that lies nearer, the first of equally near ones."""
    gap = (pair**2).sum(1) - 2 * rows @ pair.T
    return (gap[:, 1] < gap[:, 0]).astype(np.int32)


def _totals(sums: DataFrame, slots: int) -> dict[int, np.ndarray]:
    found: dict[int, np.ndarray] = {}
    for row in sums.collect():
        found.setdefault(row["grp"], np.zeros(slots))[row["slot"]] = row["value"]
    return found


def row_neighbors(
    points: DataFrame, id_col: str, k: int = OVERLAP_NEIGHBORS, search: str = "exact"
) -> DataFrame:
    """``(query, neighbor)`` over all points."""
    return neighbors.searcher(search)(points, k, id_col=id_col).select("query", "neighbor")


def expand_region(
    core: DataFrame, pairs: DataFrame, id_col: str, overlap: float = 0.2
) -> DataFrame:
    """``(unit, id, role)``: each unit's rows plus a share of its outside neighbours.

    ``core`` is ``(id, unit)`` with every row in at most one unit.
    """
    home = core.select(F.col(id_col).alias("query"), F.col("unit"))
    reached = pairs.join(home, "query").select("unit", F.col("neighbor").alias(id_col)).distinct()
    boundary = _boundary(core, reached, id_col, overlap)
    return core.select("unit", id_col, F.lit("core").alias("role")).unionByName(
        boundary.withColumn("role", F.lit("boundary"))
    )


def _boundary(core: DataFrame, reached: DataFrame, id_col: str, overlap: float) -> DataFrame:
    """``(unit, id)``: of the rows that units reach, each unit's share of those outside it."""
    other = core.select(id_col, F.col("unit").alias("other"))
    outside = (
        reached.join(other, id_col, "left")
        .where(~F.col("unit").eqNullSafe(F.col("other")))
        .select("unit", id_col)
    )
    quota = core.groupBy("unit").agg(
        F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(overlap))).alias("quota")
    )
    # The quota needs two passes; quotas are one row per unit.
    sized = cut_lineage(outside.join(F.broadcast(quota), "unit"))
    return quota_per_group(sized, "unit", id_col, "quota").select("unit", id_col)


# --- alignment ------------------------------------------------------------------------


def align_basis(vectors: np.ndarray, values: np.ndarray, reference: np.ndarray) -> AlignedBasis:
    """Match columns to the reference, fix their signs, then rotate onto it.

    With full bases the rotation reproduces the reference up to one reflection,
    so only truncated bases carry information about how well regions agree.
    """
    order = np.argsort(smallmath.best_matching(np.abs(vectors.T @ reference)))
    matched = vectors[:, order]
    flips = np.where((matched * reference).sum(axis=0) < 0, -1.0, 1.0)
    matched = matched * flips
    left, _, right = np.linalg.svd(matched.T @ reference)
    corner = np.ones(left.shape[0])
    corner[-1] = np.linalg.det(left @ right)
    rotation = (left * corner) @ right
    aligned = matched @ rotation
    score = float(np.abs((aligned * reference).sum(axis=0)).mean())
    return AlignedBasis(aligned, values[order], rotation, score)


def alignment_quality(score: Column) -> Column:
    """Category of an alignment score by its residual ``1 - score``."""
    residual = 1.0 - score
    return (
        F.when(residual < 0.05, "excellent")
        .when(residual < 0.15, "good")
        .when(residual < 0.30, "acceptable")
        .when(residual < 0.50, "poor")
        .otherwise("divergent")
    )


def is_divergent(score: Column, threshold: float = DIVERGENT_SCORE) -> Column:
    return score < threshold


# --- chart quality on sampled rows ---------------------------------------------------------


def _sample_pairs(n: int, limit: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    count = min(limit, n * (n - 1) // 2)
    left, right = draw.integers(0, n, count), draw.integers(0, n, count)
    return left, np.where(left == right, (right + 1) % n, right)


def _pair_lengths(rows: np.ndarray, pairs) -> np.ndarray:
    return np.linalg.norm(rows[pairs[0]] - rows[pairs[1]], axis=1)


def _injectivity(rows, basis, pairs) -> float:
    return smallmath.spearman(_pair_lengths(rows, pairs), _pair_lengths(rows @ basis, pairs))


def select_chart_basis(vectors: np.ndarray, rows: np.ndarray, q: int) -> list[int]:
    """Columns of ``vectors`` for a q-dimensional chart.

    Starts with the last q and tries up to ten single swaps, keeping those that
    preserve the order of distances better.
    """
    k = vectors.shape[1]
    chosen = list(range(k - q, k))
    if len(rows) < 2:
        return chosen
    pairs = _sample_pairs(len(rows), SAMPLE_PAIRS, 1)
    best, tried = _injectivity(rows, vectors[:, chosen], pairs), 0
    for position in range(q):
        for candidate in [c for c in range(k) if c not in chosen]:
            if tried == MAX_SWAPS:
                return chosen
            tried += 1
            trial = chosen[:position] + [candidate] + chosen[position + 1 :]
            value = _injectivity(rows, vectors[:, trial], pairs)
            if value > best:
                chosen, best = trial, value
                break
    return chosen


def _continuity_ratio(rows: np.ndarray, basis: np.ndarray) -> float:
    """99th percentile over median of the chart-to-ambient distance ratios."""
    few = rows[:CONTINUITY_POINTS]
    ambient = neighbors.distance_block(few, few, "euclidean")
    chart = neighbors.distance_block(few @ basis, few @ basis, "euclidean")
    usable = ~np.eye(len(few), dtype=bool) & (ambient >= 1e-12)
    if len(rows) < MIN_CHART_ROWS or not usable.any():
        return 0.0
    ratios = chart[usable] / ambient[usable]
    median = np.median(ratios)
    return float(np.percentile(ratios, 99) / median) if median > 0 else math.inf


def _distortion(basis: np.ndarray) -> float:
    singular = np.linalg.svd(basis, compute_uv=False)
    return float(singular[0] / singular[-1]) if singular[-1] >= 1e-12 else math.inf


def injectivity(pairs: DataFrame, group: str = "chart_id") -> DataFrame:
    """Rank correlation of ``ambient`` and ``chart`` distances of given pairs, per group."""
    return rank_correlation(pairs, group, "ambient", "chart", "injectivity")


def continuity(pairs: DataFrame, group: str = "chart_id") -> DataFrame:
    """Whether the distance ratios of given pairs stay near their median, per chart."""
    ratio = F.when(F.col("ambient") >= 1e-12, F.col("chart") / F.col("ambient"))
    names = [r[group] for r in pairs.select(group).distinct().collect()]  # charts are few
    found = exact_quantiles(pairs, {str(n): F.when(F.col(group) == n, ratio) for n in names}, [0.5, 0.99])
    rows = [
        (name, middle is None or top < CONTINUITY_FACTOR * middle)
        for name, (middle, top) in ((n, found[str(n)]) for n in names)
    ]
    kind = pairs.schema[group].dataType.simpleString()
    return pairs.sparkSession.createDataFrame(rows, f"{group} {kind}, continuous boolean")


def chart_quality(alignment: Column, distortion: Column, injective: Column) -> Column:
    """Mean of alignment, ``1 / (1 + distortion)`` and injectivity, each in [0, 1]."""
    parts = [alignment, 1.0 / (1.0 + distortion), injective]
    bounded = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) for p in parts]
    return (bounded[0] + bounded[1] + bounded[2]) / 3.0


_BUILT = (
    "unit int, basis array<double>, aligned array<double>, alignment_score double, "
    "selected array<int>, injectivity double, proxy double, continuity double, distortion double"
)


def _build_units(sample: DataFrame, edges: DataFrame, reference: np.ndarray, d: int, q: int):
    """Local basis, selection and sampled checks of every unit: d x d work per group.

    A group is at most SAMPLE_POINTS rows and one d x d edge list.
    """
    check_broadcast(d, 8 * reference.shape[1], "the reference basis")

    def build(rows: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame()
        weights = smallmath.symmetric(graph, d) if len(graph) else np.zeros((d, d))
        values, vectors = smallmath.sorted_eigen(
            smallmath.laplacian_matrix(weights), reference.shape[1]
        )
        aligned = align_basis(vectors, values, reference)
        points = np.stack(rows.sort_values(["_order", "_id"])["features"].to_numpy())
        chosen = select_chart_basis(aligned.vectors, points, q)
        basis = aligned.vectors[:, chosen]
        enough = len(points) >= 2
        gate = _injectivity(points, basis, _sample_pairs(len(points), SAMPLE_PAIRS, 42)) if enough else 1.0
        proxy = _injectivity(points, basis, _sample_pairs(len(points), PROXY_PAIRS, 99)) if enough else 1.0
        return pd.DataFrame(
            {
                "unit": [int(rows["unit"].iloc[0])],
                "basis": [basis.ravel().tolist()],
                "aligned": [aligned.vectors.ravel().tolist()],
                "alignment_score": [aligned.score],
                "selected": [chosen],
                "injectivity": [gate],
                "proxy": [proxy],
                "continuity": [_continuity_ratio(points, basis)],
                "distortion": [_distortion(basis)],
            }
        )

    return sample.groupBy("unit").cogroup(edges.groupBy("unit")).applyInPandas(build, _BUILT)


# --- assignment, overlaps, coverage -----------------------------------------------------------


def primary_chart(points: DataFrame, members: DataFrame, charts: DataFrame, id_col: str) -> DataFrame:
    """``(id, chart_id)``: the covering chart with the best alignment, else chart 0."""
    scores = F.broadcast(charts.select("chart_id", "alignment_score"))  # one row per chart
    best = (
        members.join(scores, "chart_id")
        .groupBy(id_col)
        .agg(F.min(F.struct((-F.col("alignment_score")).alias("s"), "chart_id")).alias("b"))
        .select(id_col, F.col("b.chart_id").alias("chart_id"))
    )
    return points.select(id_col).join(best, id_col, "left").na.fill({"chart_id": 0})


def chart_overlaps(members: DataFrame, id_col: str) -> DataFrame:
    """``(chart_i, chart_j, id)`` for every point two charts share, ``chart_i < chart_j``."""
    charts = F.array_sort(F.collect_set("chart_id"))  # at most the number of charts
    later = F.slice("charts", F.col("p") + 2, F.greatest(F.size("charts") - F.col("p") - 1, F.lit(0)))
    return (
        members.groupBy(id_col)
        .agg(charts.alias("charts"))
        .where(F.size("charts") > 1)
        .select(id_col, "charts", F.posexplode("charts").alias("p", "chart_i"))
        .select(id_col, "chart_i", F.explode(later).alias("chart_j"))
        .select("chart_i", "chart_j", id_col)
    )


def coverage(points: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """Share of points that are a member of at least one chart."""
    covered = members.select(F.col(id_col), F.lit(1).alias("hit")).distinct()
    joined = points.select(id_col).join(covered, id_col, "left")
    return joined.agg(
        F.count("hit").alias("covered"),
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("coverage"),
    )


def tangent_variation(charts: list[np.ndarray]) -> float:
    """Mean of the largest principal angle between consecutive chart bases."""
    if len(charts) < 2:
        return 0.0
    angles = [
        np.arccos(np.clip(np.linalg.svd(a.T @ b, compute_uv=False), -1.0, 1.0)).max()
        for a, b in zip(charts, charts[1:])
    ]
    return float(np.mean(angles))


# --- the whole atlas ------------------------------------------------------------------------


class _AtlasBuilder:
    """Driver side of the atlas: which units to try next. Units are sets of rows."""

    def __init__(self, points, id_col, spectrum, q, overlap, max_retries, search):
        self.points = points.select(F.col(id_col), "features")
        self.id_col, self.q = id_col, q
        self.overlap, self.max_retries = overlap, max_retries
        self.d = width_of(points, "features")
        self.reference = spectrum.basis.vectors
        # Rows with equal features have the same neighbours, which are held once.
        self.rows, self.lists = neighbors.knn_shared(self.points, OVERLAP_NEIGHBORS, search, id_col)
        self.charts: list[Chart] = []
        self.rejected: list[int] = []

    def run(self, regions: DataFrame) -> DataFrame:
        """Build charts for all regions; returns ``(id, unit, rep, features)`` with final units."""
        core = cut_lineage(regions.withColumnRenamed("region", "unit").join(self.rows, self.id_col))
        sizes = {r["unit"]: r["count"] for r in core.groupBy("unit").count().collect()}
        self.next_unit = max(sizes) + 1
        queues = {region: [region] for region in sorted(sizes)}
        retries = dict.fromkeys(queues, 0)
        done: dict[int, Chart] = {}
        while queues:
            # The first chart fixes the reference of all others, so it is found alone.
            active = list(queues) if done else [next(iter(queues))]
            heads = {}
            for region in active:
                if not queues[region] or retries[region] > self.max_retries:
                    self.rejected.append(region)
                    del queues[region]
                    continue
                unit = queues[region].pop(0)
                if sizes[unit] < MIN_CHART_ROWS:
                    retries[region] += 1
                else:
                    heads[region] = unit
            if not heads:
                continue
            built = self._attempt(core, list(heads.values()))
            failed: dict[int, int] = {}
            for region, unit in heads.items():
                if built[unit] is not None:
                    done[region] = built[unit]
                    del queues[region]
                    if len(done) == 1:
                        self.reference = built[unit].aligned
                    continue
                retries[region] += 1
                if sizes[unit] >= MIN_SPLIT_ROWS:
                    failed[unit] = region
            if failed:
                core, halves = self._split(core, list(failed))
                for unit, region in failed.items():
                    sizes.update(halves[unit])
                    queues[region] += [u for u, n in halves[unit].items() if n >= MIN_CHART_ROWS]
        for number, region in enumerate(sorted(done)):
            chart = done[region]
            self.charts.append(Chart(**{**chart.__dict__, "chart_id": number}))
        return core

    def _attempt(self, core: DataFrame, units: list[int]) -> dict[int, Chart | None]:
        mine = core.where(F.col("unit").isin(units))
        reached = (
            mine.select("rep", "unit")
            .distinct()
            .join(self.lists, "rep")
            .select("unit", F.explode("neighbors").alias(self.id_col))
            .distinct()
        )
        boundary = _boundary(mine, reached, self.id_col, self.overlap)
        boundary = cut_lineage(boundary.join(self.points, self.id_col))
        inside = mine.select("unit", self.id_col, "features")
        located = inside.unionByName(boundary)
        edges = build_edges(located, "features", by="unit", d=self.d).select(
            F.col("unit").cast("int").alias("unit"), "i", "j", "weight"
        )
        sample = first_per_group(
            inside.select("unit", F.col(self.id_col).alias("_id"), "features").withColumn(
                "_order", hash_order("_id", 1)
            ),
            ["unit"],
            ["_order", "_id"],
            SAMPLE_POINTS,
        )
        built = _build_units(sample, edges, self.reference, self.d, self.q).collect()
        bases = {r["unit"]: np.array(r["basis"]).reshape(self.d, self.q) for r in built}
        shares = {
            r["chart_id"]: r["tangent_share"]
            for r in tangent_share(inside.withColumnRenamed("unit", "chart_id"), bases).collect()
        }
        return {r["unit"]: self._accept(r, bases[r["unit"]], shares[r["unit"]]) for r in built}

    def _accept(self, row, basis: np.ndarray, share: float) -> Chart | None:
        valid = (
            row["injectivity"] >= INJECTIVITY_GATE
            and row["continuity"] < CONTINUITY_FACTOR
            and share < TANGENT_LIMIT
        )
        if not valid:
            return None
        clip = lambda x: min(max(x, 0.0), 1.0)
        score = (clip(row["alignment_score"]) + clip(1 / (1 + row["distortion"])) + clip(row["proxy"])) / 3
        residual = 1.0 - row["alignment_score"]
        names = ((0.05, "excellent"), (0.15, "good"), (0.30, "acceptable"), (0.50, "poor"))
        quality = next((name for limit, name in names if residual < limit), "divergent")
        aligned = np.array(row["aligned"]).reshape(self.d, -1)
        return Chart(
            -1, row["unit"], basis, aligned, row["alignment_score"], quality,
            list(row["selected"]), row["injectivity"], row["distortion"], score,
        )

    def _split(self, core: DataFrame, units: list[int]):
        """Halve all failed units of a round together; the table of units is written once."""
        first = {unit: self.next_unit + 2 * i for i, unit in enumerate(units)}
        owner = {first[u] + half: u for u in units for half in (0, 1)}
        self.next_unit += 2 * len(units)
        rows = core.where(F.col("unit").isin(units)).select(self.id_col, "unit", "features")
        number = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
        new = (number[F.col("unit")] + F.col("half")).cast("int").alias("new")
        halves = split_regions(rows, self.id_col, "unit").select(self.id_col, new)
        renamed = core.join(halves, self.id_col, "left")
        renamed = cut_lineage(
            renamed.select(self.id_col, F.coalesce("new", "unit").alias("unit"), "rep", "features")
        )
        counts: dict[int, dict[int, int]] = {unit: {} for unit in units}
        for r in renamed.where(F.col("unit").isin(list(owner))).groupBy("unit").count().collect():
            counts[owner[r["unit"]]][r["unit"]] = r["count"]
        return renamed, counts


def nearest_chart(points: DataFrame, members: DataFrame, id_col: str, d: int) -> DataFrame:
    """``(id, nearest)``: for points in no chart, the chart whose mean lies nearest.

    ``members`` may hold the features already.
    """

    def sums(rows: np.ndarray) -> np.ndarray:
        return np.append(rows.sum(axis=0), len(rows))

    located = members
    if "features" not in members.columns:
        located = members.join(points.select(id_col, "features"), id_col)
    means = _totals(partial_sums(located, "features", d + 1, sums, "chart_id"), d + 1)
    names = np.array(sorted(means))
    check_broadcast(len(names), 8 * d, "the chart means")
    centres = np.array([means[n][:d] / means[n][d] for n in names])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                rows = to_matrix(batch.column(1))
                gap = (centres**2).sum(axis=1) - 2 * rows @ centres.T
                found = pa.array(names[gap.argmin(axis=1)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[id_col, "nearest"])

    outside = points.select(id_col, "features").join(members.select(id_col), id_col, "left_anti")
    kind = points.schema[id_col].dataType.simpleString()
    return outside.mapInArrow(place, f"{id_col} {kind}, nearest int")


def build_atlas(
    points: DataFrame,
    id_col: str,
    spectrum: Spectrum,
    intrinsic_dim: int,
    n_charts="auto",
    overlap: float = 0.2,
    max_retries: int = 3,
    search: str = "approx",
    regions: DataFrame | None = None,
    uncovered: str = "nearest",
) -> Atlas:
    """Charts over ``(id, features, coeffs)`` and the chart of every point.

    Points of regions without a valid chart go to the chart with the nearest mean,
    or with ``uncovered="chart0"`` to chart 0.
    """
    if uncovered not in ("nearest", "chart0"):
        raise ValueError("uncovered must be 'nearest' or 'chart0'")
    if regions is None:
        regions = partition_regions(points, id_col, intrinsic_dim, n_charts)
    builder = _AtlasBuilder(
        points, id_col, spectrum, intrinsic_dim, overlap, max_retries, search
    )
    units = builder.run(regions)
    charts = builder.charts
    if not charts:
        raise RuntimeError("no region gave a valid chart")
    spark = points.sparkSession
    numbers = spark.createDataFrame([(c.unit, c.chart_id) for c in charts], "unit int, chart_id int")
    located = units.join(F.broadcast(numbers), "unit").select("chart_id", id_col, "features")
    members = located.select("chart_id", id_col)
    atlas = Atlas(charts, members, None, None, builder.rejected)
    atlas.assignments = primary_chart(points, members, atlas.charts_df(spark), id_col)
    if uncovered == "nearest":
        nearest = nearest_chart(points, located, id_col, builder.d)
        placed = atlas.assignments.join(nearest, id_col, "left")
        atlas.assignments = placed.select(id_col, F.coalesce("nearest", "chart_id").alias("chart_id"))
    atlas.coverage = coverage(points, members, id_col)
    return atlas
