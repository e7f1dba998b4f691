"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to length one; a table's bucket is a run of quantised random
projections ``floor((a . x + b) / width)``. Their number follows the number of
vectors, so that unrelated vectors share few buckets, and the number of tables
follows from the chance wanted for a pair at the threshold. Buckets are compared
in tiles with exact cosines; a pair is counted in the first table where it meets.
Equal vectors are one class from the start, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietband.llm.common import store
from quietband.llm.jaccard_join import forest
from quietband.llm.shingles import _multipliers, mixed
from quietband.llm.vectors import matrix, usable
from quietband.operators.graph import connected_components

COSINE = 0.95
WIDTH = 2.0
# Chance that a pair exactly at the threshold meets in some table.
FOUND = 0.98
# Unrelated vectors (at right angles) expected in a bucket.
STRANGERS = 4
TILE = 256


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for two points at a distance."""
    c = width / distance
    normal = math.erfc(c / math.sqrt(2))
    return 1 - normal - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def table_shape(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections per table and number of tables."""
    far = collision(math.sqrt(2))
    near = collision(math.sqrt(2 - 2 * cosine))
    width = max(1, math.ceil(math.log(max(vectors / STRANGERS, 2)) / -math.log(far)))
    return width, max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - near**width)))


def _codes(points: np.ndarray, width: int, tables: int, seed: int) -> np.ndarray:
    """64-bit bucket names, one column per table."""
    rng = np.random.default_rng(seed)
    ways = rng.normal(size=(points.shape[1], width * tables))
    shift = rng.uniform(0, WIDTH, size=width * tables)
    cells = np.floor((points @ ways + shift) / WIDTH).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(points), tables, width) * _multipliers(width, 5)
    named = _multipliers(tables, 6) * np.uint64(2 * points.shape[1] + 1)  # one length, one set of names
    return mixed(cells.sum(axis=2, dtype=np.uint64) + named).view(np.int64)


def _hashed(classes: DataFrame, width: int, tables: int, seed: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows may differ in length; each length has hash functions of its own.
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                points = matrix(part.column(2))
                unit = points / np.abs(points).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                codes = _codes(unit, width, tables, seed + int(length))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1)]
                    + [pa.array([row.tobytes() for row in m], pa.binary()) for m in (unit, codes)]
                    + [pa.array(list(codes), pa.list_(pa.int64()))],
                    names=["key", "copies", "point", "codes", "buckets"],
                )

    schema = "key long, copies long, point binary, codes binary, buckets array<long>"
    return classes.select("key", "copies", "vector").mapInArrow(emit, schema)


def _compare(cosine: float):
    """Per tile: links each class has there ``(i, NULL, n)``, and a spanning forest ``(i, j, 0)``."""

    def close(name, rows):
        if len(rows) < 2:
            return []
        keys, sides, copies, points, codes = zip(*rows)
        x = np.frombuffer(b"".join(points)).reshape(len(rows), -1)
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if name[2] != name[3]:
            side = np.array(sides)
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return []
        found = [(keys[i], keys[j], 0) for i, j in forest(linked)]
        code = np.frombuffer(b"".join(codes), np.int64).reshape(len(rows), -1)
        for earlier in range(name[0]):
            column = code[:, earlier]
            linked &= column[:, None] != column[None, :]
        counts = linked @ np.array(copies)
        return found + [(keys[i], None, int(counts[i])) for i in np.flatnonzero(counts)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []
        for batch in batches:
            found = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(9)]):
                if row[:4] != name:
                    found += close(name, rows)
                    name, rows = row[:4], []
                rows.append(row[4:])
            yield _found(found)
        yield _found(close(name, rows))

    return compare


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", "n"])


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    seed: int = 7,
) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per row of ``table``.

    NULL, zero and non-finite vectors link with nothing; vectors of different
    length do not link. Rows with the same vector link with each other. A NULL id
    counts as a neighbour but names no component unless it stands alone. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.where(usable("vector"))
    classes = store(
        good.groupBy("vector")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        .withColumn("key", F.monotonically_increasing_id()),
        "classes",
    )
    width, tables = table_shape(classes.count(), cosine)
    hashed = store(_hashed(classes, width, tables, seed), "hashed")
    entries = hashed.select("key", F.posexplode("buckets").alias("t", "bucket"))
    sizes = entries.groupBy("t", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    sides = F.ceil(F.col("size") / F.lit(TILE))
    tiles = (
        entries.join(sizes, ["t", "bucket"])
        .withColumn("sides", sides)
        .withColumn("side", F.pmod(F.xxhash64("key"), F.col("sides")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        .withColumn("low", F.least("side", "other"))
        .withColumn("high", F.greatest("side", "other"))
    )
    columns = ["t", "bucket", "low", "high", "key", "side", "copies", "point", "codes"]
    found = store(
        tiles.join(hashed.drop("buckets"), "key")
        .select(*columns)
        .repartition("t", "bucket", "low", "high")
        .sortWithinPartitions("t", "bucket", "low", "high", "key")
        .mapInArrow(_compare(cosine), "i long, j long, n long"),
        "links",
    )
    links = found.where("j is null").groupBy(F.col("i").alias("key")).agg(F.sum("n").alias("n"))
    edges = found.where("j is not null").select("i", "j").distinct()
    labels = connected_components(edges.withColumn("weight", F.lit(1.0)))
    named = labels.join(classes, F.col("node") == F.col("key"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(smallest, "component").select("key", "component_id")
    told = (
        classes.join(links, "key", "left")
        .join(linked, "key", "left")
        .where("n is not null or copies > 1")
        .select(
            F.col("vector").alias("v"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    joined = good.join(told, F.col("vector") == F.col("v"), "left").select("id", "n_links", "component_id")
    alone = rows.where(~usable("vector")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    named = joined.unionByName(alone).withColumn("component_id", F.coalesce("component_id", "id"))
    return named.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )
