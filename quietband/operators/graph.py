"""Operators on undirected edge tables ``(i, j, weight)``, each edge listed once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietband.session import cut_lineage, shuffles_removed


def both_directions(edges: DataFrame) -> DataFrame:
    """Adjacency with every edge as ``(i, j)`` and ``(j, i)``."""
    ends = F.explode(
        F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return edges.select(ends.alias("e"), "weight").select("e.i", "e.j", "weight")


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, degree)``, the weights summed over both ends of each edge."""
    summed = (
        both_directions(edges).groupBy(F.col("i").alias("node")).agg(F.sum("weight").alias("degree"))
    )
    if nodes is None:
        return summed
    return nodes.select("node").join(summed, "node", "left").na.fill({"degree": 0.0})


def laplacian(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Non-zero entries ``(i, j, value)`` of ``D - W``."""
    diagonal = degrees(edges, nodes).select(
        F.col("node").alias("i"), F.col("node").alias("j"), F.col("degree").alias("value")
    )
    rest = both_directions(edges).select("i", "j", (-F.col("weight")).alias("value"))
    return diagonal.unionByName(rest)


def normalized_laplacian(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Entries of ``D^-1/2 (D - W) D^-1/2``; isolated nodes get 0."""
    degree = degrees(edges)
    left = degree.select(F.col("node").alias("i"), F.col("degree").alias("di"))
    right = degree.select(F.col("node").alias("j"), F.col("degree").alias("dj"))
    scaled = laplacian(edges, nodes).join(left, "i", "left").join(right, "j", "left")
    value = F.try_divide(F.col("value"), F.sqrt(F.col("di") * F.col("dj")))
    return scaled.select("i", "j", F.coalesce(value, F.lit(0.0)).alias("value"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` with the smallest node of the component as its name.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    logarithmically many rounds whatever the diameter, and each step is a
    map-side combined minimum plus a join.
    """
    pairs = cut_lineage(
        edges.where((F.col("weight") != 0) & (F.col("i") != F.col("j")))
        .select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v"))
        .distinct()
    )
    before = None
    while (state := _fingerprint(pairs)) != before:
        before = state
        pairs = cut_lineage(_small_star(_large_star(pairs)))
    known = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    labelled = known.unionByName(roots)
    if nodes is None:
        return labelled
    return (
        nodes.select("node")
        .join(labelled, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )


def _fingerprint(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(row)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    sides = F.explode(
        F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    )
    full = pairs.select(sides.alias("e")).select("e.u", "e.v")
    smallest = full.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return full.where(F.col("v") > F.col("u")).join(smallest, "u").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    ).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    neighbours = pairs.join(smallest, "u").where(F.col("v") != F.col("m"))
    return (
        neighbours.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(smallest.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _relax(adjacency: DataFrame, start: DataFrame) -> DataFrame:
    """Distances ``(source, node, distance)`` by repeated frontier relaxation.

    Only nodes whose distance shrank in a round are joined with their edges in
    the next one. Weights must not be negative.
    """
    known = cut_lineage(start.withColumn("changed", F.lit(True)))
    while not known.where("changed").isEmpty():
        frontier = known.where("changed").select(
            "source", F.col("node").alias("i"), F.col("distance").alias("base")
        )
        offers = (
            frontier.join(adjacency, "i")
            .groupBy("source", F.col("j").alias("node"))
            .agg(F.min(F.col("base") + F.col("weight")).alias("offer"))
        )
        merged = known.drop("changed").join(offers, ["source", "node"], "full_outer")
        better = F.col("offer") < F.coalesce("distance", F.lit(math.inf))
        known = cut_lineage(
            merged.select(
                "source",
                "node",
                F.least("distance", "offer").alias("distance"),
                F.coalesce(better, F.lit(False)).alias("changed"),
            )
        )
    return known.drop("changed")


def _positive_adjacency(edges: DataFrame) -> DataFrame:
    return both_directions(edges.where((F.col("weight") > 0) & (F.col("i") != F.col("j"))))


def shortest_paths(edges: DataFrame, nodes: DataFrame, source) -> DataFrame:
    """``(node, distance)`` from one node; unreachable nodes get infinity."""
    adjacency = cut_lineage(_positive_adjacency(edges))
    node_type = nodes.schema["node"].dataType
    start = nodes.sparkSession.range(1).select(
        F.lit(source).cast(node_type).alias("source"),
        F.lit(source).cast(node_type).alias("node"),
        F.lit(0.0).alias("distance"),
    )
    found = _relax(adjacency, start).drop("source")
    return nodes.select("node").join(found, "node", "left").na.fill({"distance": math.inf})


def graph_diameter(edges: DataFrame, nodes: DataFrame, sources_per_round: int = 16) -> float:
    """Longest shortest path, infinite for a disconnected graph.

    Eccentricity bounds (Takes and Kosters, 2011) replace the all-pairs table:
    after each batch of single-source searches every node has an upper and a
    lower bound, and only nodes that could still exceed the best path found are
    searched. The state is one row per node.
    """
    adjacency = cut_lineage(_positive_adjacency(edges))
    everyone = cut_lineage(nodes.select("node").distinct())
    total = everyone.count()
    weight_of = degrees(edges, everyone).withColumnRenamed("degree", "priority")
    bounds = cut_lineage(
        weight_of.select("node", "priority", F.lit(0.0).alias("low"), F.lit(math.inf).alias("high"))
    )
    best, first = 0.0, True
    while True:
        # Well connected nodes first tighten the upper bounds of everyone else.
        order = [F.desc("priority")] if first else [F.desc("high"), F.asc("low")]
        chosen = (
            bounds.where(F.col("high") > best)
            .orderBy(*order, "node")
            .limit(sources_per_round)
            .select(F.col("node").alias("source"))
        )
        start = chosen.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"))
        paths = _relax(adjacency, start)
        reach = paths.groupBy("source").agg(
            F.max("distance").alias("ecc"), F.count("*").alias("reached")
        )
        seen = reach.agg(F.max("ecc"), F.min("reached")).first()
        if seen[1] is None:
            return best
        if seen[1] < total:
            return math.inf
        best, first = max(best, seen[0]), False
        tightened = (
            paths.join(F.broadcast(reach), "source")  # at most sources_per_round rows
            .groupBy("node")
            .agg(
                F.max(F.greatest(F.col("distance"), F.col("ecc") - F.col("distance"))).alias("l"),
                F.min(F.col("ecc") + F.col("distance")).alias("h"),
            )
        )
        own = reach.select(F.col("source").alias("node"), F.col("ecc"))
        bounds = cut_lineage(
            bounds.join(tightened, "node")
            .join(F.broadcast(own), "node", "left")
            .select(
                "node",
                "priority",
                F.coalesce("ecc", F.greatest("low", "l")).alias("low"),
                F.coalesce("ecc", F.least("high", "h")).alias("high"),
            )
        )


def clustering_coefficient(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Mean local clustering coefficient over all nodes, weights ignored.

    Edges point from the lower to the higher degree, so no neighbour list is
    longer than sqrt(2 * edges) even at a hub, and triangles come from
    intersecting two lists instead of listing the pairs around a node.
    """
    with shuffles_removed(edges.sparkSession):
        simple = cut_lineage(
            edges.where((F.col("weight") > 0) & (F.col("i") != F.col("j")))
            .select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(1.0).alias("weight"))
            .distinct()
        )
        degree = cut_lineage(degrees(simple))
        ranked = simple.join(
            degree.select(F.col("node").alias("i"), F.col("degree").alias("di")), "i"
        ).join(degree.select(F.col("node").alias("j"), F.col("degree").alias("dj")), "j")
        left, right = F.struct(F.col("di").alias("d"), F.col("i").alias("n")), F.struct(F.col("dj").alias("d"), F.col("j").alias("n"))
        lists = cut_lineage(
            ranked.select(F.least(left, right)["n"].alias("a"), F.greatest(left, right).alias("b"))
            .groupBy("a")
            .agg(F.array_sort(F.collect_list("b")).alias("out"))
            .select("a", F.col("out.n").alias("out"))
        )
    # A triangle is closed by its first node's neighbours after the second: only these travel.
    later = F.slice("out", F.col("p") + 2, F.greatest(F.size("out") - F.col("p") - 1, F.lit(0)))
    wedges = (
        lists.where(F.size("out") > 1)
        .select("a", "out", F.posexplode("out").alias("p", "b"))
        .where(F.col("p") < F.size("out") - 1)
        .select("a", "b", later.alias("rest"))
    )
    triangles = (
        wedges.join(lists.select(F.col("a").alias("b"), F.col("out").alias("out_b")), "b")
        .select("a", "b", F.explode(F.array_intersect("rest", "out_b")).alias("c"))
        .select(F.explode(F.array("a", "b", "c")).alias("node"))
        .groupBy("node")
        .agg(F.count("*").alias("triangles"))
    )
    base = degree if nodes is None else nodes.select("node").join(degree, "node", "left")
    k = F.coalesce("degree", F.lit(0.0))
    local = F.try_divide(2.0 * F.coalesce("triangles", F.lit(0)), k * (k - 1))
    return base.join(triangles, "node", "left").agg(
        F.avg(F.when(k >= 2, local).otherwise(0.0)).alias("clustering_coefficient")
    )
