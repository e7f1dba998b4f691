"""Tables behind a 3-D view of scored points."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietband.functions.partials import partial_sums
from quietband.operators.spectral import mean_power
from quietband.session import check_broadcast, cut_lineage

NEAREST_NORMALS = 20
OVERLAP_FACTOR = 1.5
SHIFT = 2.5
MIN_NORMALS = 5
DETAIL_VALUES = 20
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Projection:
    axes: list[int]
    points: DataFrame
    clusters: DataFrame


def top3_axes(power: DataFrame) -> DataFrame:
    """The three strongest components in ascending order; 0 is skipped when d > 3."""
    d = power.agg(F.count("*")).scalar()
    strongest = power.where((d <= 3) | (F.col("k") > 0)).orderBy(F.desc("power"), "k").limit(3)
    return strongest.select("k").orderBy("k")


def project_3d(df: DataFrame, axes: list[int], coeffs: str = "coeffs") -> DataFrame:
    """Add ``x, y, z``: the chosen coefficients, standardised over all rows."""
    raw = [F.get(F.col(coeffs), F.lit(a)) for a in axes]
    row = df.agg(*[F.avg(c) for c in raw], *[F.stddev_pop(c) for c in raw]).first()
    means, stds = row[: len(axes)], row[len(axes) :]
    return df.withColumns(
        {n: (c - m) / (s if s else 1.0) for n, c, m, s in zip(AXES, raw, means, stds)}
    )


def classify_points(df: DataFrame, flag: str = "is_anomaly", label: str | None = "cluster") -> DataFrame:
    """Add ``klass`` (normal, isolated, cluster) and ``cluster_id``."""
    in_cluster = F.lit(False) if label is None else F.coalesce(F.col(label) >= 0, F.lit(False))
    klass = F.when(~F.col(flag), "normal").when(in_cluster, "cluster").otherwise("isolated")
    cluster = F.when(F.col(flag) & in_cluster, F.lit(-1) if label is None else F.col(label))
    return df.withColumns({"klass": klass, "cluster_id": cluster.cast("int")})


def _position() -> list[Column]:
    return [F.col(a) for a in AXES]


def _length(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def cluster_overlap(points: DataFrame, threshold: float = OVERLAP_FACTOR) -> DataFrame:
    """``(cluster_id, mean_near, spread, overlaps)`` of clusters against normal points.

    Needs ``x, y, z, klass, cluster_id``. Every task keeps the 20 normal points
    nearest to each centroid and passes only those on.
    """
    centroids = (
        points.where(F.col("klass") == "cluster")
        .groupBy("cluster_id")
        .agg(*[F.avg(c).alias(a) for a, c in zip(AXES, _position())])
        .collect()
    )
    check_broadcast(len(centroids), 32, "the cluster centroids")
    ids = np.array([r["cluster_id"] for r in centroids], dtype=np.int32)
    places = np.array([[r[a] for a in AXES] for r in centroids]).reshape(len(ids), 3)
    normal = points.where(F.col("klass") == "normal").select(*AXES)
    middle = normal.agg(F.count("*"), *[F.avg(c) for c in _position()]).first()
    offset = [c - F.lit(m) for c, m in zip(_position(), middle[1:])]
    spread = normal.agg(F.avg(_length(offset)).alias("spread")).first()[0] if middle[0] else None

    def nearest(batches):
        kept = np.full((len(ids), NEAREST_NORMALS), np.inf)
        for batch in batches:
            rows = batch[list(AXES)].to_numpy()
            for i, place in enumerate(places):
                gaps = np.linalg.norm(rows - place, axis=1)
                kept[i] = np.sort(np.concatenate([kept[i], gaps]))[:NEAREST_NORMALS]
        who, which = np.nonzero(np.isfinite(kept))
        yield pd.DataFrame({"cluster_id": ids[who], "gap": kept[who, which]})

    rank = Window.partitionBy("cluster_id").orderBy("gap")
    close = (
        normal.mapInPandas(nearest, "cluster_id int, gap double")
        .withColumn("r", F.row_number().over(rank))
        .where(F.col("r") <= NEAREST_NORMALS)
        .groupBy("cluster_id")
        .agg(F.avg("gap").alias("mean_near"))
    )
    everyone = points.sparkSession.createDataFrame([(int(i),) for i in ids], "cluster_id int")
    limit = F.lit(spread) * 1.0 + 1e-9 if spread is not None else F.lit(None).cast("double")
    overlaps = (F.lit(middle[0]) >= 2) & (F.col("mean_near") < threshold * limit)
    return everyone.join(F.broadcast(close), "cluster_id", "left").select(
        "cluster_id",
        "mean_near",
        F.lit(spread).cast("double").alias("spread"),
        F.coalesce(overlaps, F.lit(False)).alias("overlaps"),
    )


def divergent_axes(points: DataFrame, coeffs: str = "coeffs") -> DataFrame:
    """``(cluster_id, axes)``: the 3 components whose mean power differs most from normal."""
    compared = points.where(F.col("klass").isin("normal", "cluster")).withColumn(
        "_group", F.when(F.col("klass") == "normal", -1).otherwise(F.col("cluster_id"))
    )
    first = points.select(F.size(coeffs)).first()
    d = first[0] if first else 0

    def block(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([(rows**2).sum(axis=0), [len(rows)]])

    sums = partial_sums(compared, coeffs, d + 1, block, by="_group")
    counts = sums.where(F.col("slot") == d).select("grp", F.col("value").alias("n"))
    power = (
        sums.where(F.col("slot") < d)
        .join(F.broadcast(counts), "grp")  # one row per group
        .select("grp", F.col("slot").cast("int").alias("k"), (F.col("value") / F.col("n")).alias("power"))
    )
    normal = power.where(F.col("grp") == -1).select("k", F.col("power").alias("base"))
    gaps = (
        power.where(F.col("grp") >= 0)
        .join(F.broadcast(normal), "k")  # one row per component
        .select(
            F.col("grp").cast("int").alias("cluster_id"),
            "k",
            F.abs(F.col("power") - F.col("base")).alias("gap"),
        )
    )
    rank = Window.partitionBy("cluster_id").orderBy(F.desc("gap"), "k")
    return (
        gaps.withColumn("r", F.row_number().over(rank))
        .where(F.col("r") <= 3)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list("k")).alias("axes"))
    )


def reproject_cluster(points: DataFrame, axes: DataFrame, id_col: str, coeffs: str = "coeffs") -> DataFrame:
    """``(id, cluster_id, x, y, z)`` of clusters on their own axes, moved off the main cloud.

    Each cluster is standardised on its divergent axes and placed 2.5 units
    from the centroid of all points. ``points`` has the overall ``x, y, z``.
    """
    centre = points.agg(*[F.avg(c) for c in _position()]).first()
    mine = points.where(F.col("klass") == "cluster").join(F.broadcast(axes), "cluster_id")
    raw = mine.select(
        id_col,
        "cluster_id",
        *[
            F.get(F.col(coeffs), F.get("axes", F.lit(i))).alias(a)
            for i, a in enumerate(AXES)
        ],
    )
    stats = raw.groupBy("cluster_id").agg(
        *[F.avg(a).alias(f"m_{a}") for a in AXES], *[F.stddev_pop(a).alias(f"s_{a}") for a in AXES]
    )
    # Standardised clusters are centred on 0, so the direction is away from the centre.
    away = [-m for m in centre]
    size = math.sqrt(sum(m * m for m in away))
    unit = [m / size if size > 1e-9 else m for m in away]
    target = [m + SHIFT * u for m, u in zip(centre, unit)]
    return raw.join(F.broadcast(stats), "cluster_id").select(
        id_col,
        "cluster_id",
        *[
            (
                (F.col(a) - F.col(f"m_{a}"))
                / F.when(F.col(f"s_{a}") == 0, 1.0).otherwise(F.col(f"s_{a}"))
                + F.lit(t)
            ).alias(a)
            for a, t in zip(AXES, target)
        ],
    )


def point_detail(
    points: DataFrame, charts: DataFrame, id_col: str, key, names: list[str], vector: str = "features"
) -> DataFrame:
    """Score, flags, chart and first values of one point, found by its key."""
    size = F.transform("z", lambda x: F.abs(x))
    top = F.concat(F.lit("band_"), (F.array_position(size, F.array_max(size)) - 1).cast("string"))
    shown = names[:DETAIL_VALUES]
    hits = F.size(F.filter("flags", lambda f: f))
    kind = F.when(hits == F.size("flags"), "global").when(hits == 1, "spectral").when(hits > 1, "partial")
    return (
        points.where(F.col(id_col) == F.lit(key))
        .join(F.broadcast(charts.select("chart_id", "alignment_score")), "chart_id", "left")
        .select(
            id_col,
            F.col("score").alias("overall_score"),
            "is_anomaly",
            F.when(F.col("is_anomaly"), kind).alias("anomaly_type"),
            F.col("z").alias("band_scores"),
            F.when(F.col("is_anomaly"), top).alias("top_anomalous_band"),
            "chart_id",
            F.coalesce("alignment_score", F.lit(0.0)).alias("chart_alignment"),
            F.map_from_arrays(
                F.array(*map(F.lit, shown)),
                F.array(*[F.get(F.col(vector), F.lit(i)) for i in range(len(shown))]),
            ).alias("values"),
        )
    )


def cluster_detail(points: DataFrame, label: str = "cluster") -> DataFrame:
    """Size, mean and maximum score of every cluster label."""
    return points.groupBy(label).agg(
        F.count("*").alias("size"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")
    )


def project(
    coefficients: DataFrame,
    id_col: str,
    scores: DataFrame | None = None,
    labels: DataFrame | None = None,
) -> Projection:
    """3-D positions and classes of all points, overlapping clusters moved apart.

    ``scores`` is ``(id, score, is_anomaly)`` and defaults to all normal;
    ``labels`` is ``(id, cluster)``.
    """
    power = mean_power(coefficients)
    axes = [r["k"] for r in top3_axes(power).collect()]
    placed = project_3d(coefficients, axes)
    if scores is None:
        placed = placed.withColumns({"score": F.lit(0.0), "is_anomaly": F.lit(False)})
    else:
        placed = placed.join(scores.select(id_col, "score", "is_anomaly"), id_col)
    if labels is not None:
        placed = placed.join(labels.select(id_col, "cluster"), id_col, "left")
    points = cut_lineage(classify_points(placed, label=None if labels is None else "cluster"))
    clusters = cluster_overlap(points)
    n_normal = points.where(F.col("klass") == "normal").count()
    moving = clusters.where(F.col("overlaps") & F.lit(n_normal >= MIN_NORMALS))
    chosen = divergent_axes(points).join(moving.select("cluster_id"), "cluster_id", "left_semi")
    moved = reproject_cluster(points, chosen, id_col).select(
        id_col, *[F.col(a).alias(f"new_{a}") for a in AXES]
    )
    final = points.join(moved, id_col, "left").select(
        id_col,
        *[F.coalesce(f"new_{a}", a).alias(a) for a in AXES],
        "score",
        "is_anomaly",
        "klass",
        "cluster_id",
        F.col("new_x").isNotNull().alias("reprojected"),
    )
    described = clusters.join(chosen, "cluster_id", "left")
    return Projection(axes, final, described)
