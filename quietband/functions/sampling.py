"""Repeatable selection by hash order instead of partition-dependent sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
HASH_BUCKETS = 65_536


def hash_order(id_col: str, seed: int = 0) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def first_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every group in the given order.

    Each group is cut to ``k`` rows per salt before its own window sees it, so
    a group holding most of the table is never gathered in one task.
    """
    salted = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)))
        .withColumn("_rank", F.row_number().over(salted))
        .where(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= k)
        .drop("_salt", "_rank")
    )


def quota_per_group(df: DataFrame, group: str, id_col: str, quota: str, seed: int = 0) -> DataFrame:
    """The ``quota`` rows of each group that come first in hash order.

    The quota may be a large share of the group, so no window runs over whole
    groups: counts per hash bucket find the bucket where the quota ends, and
    only the rows of that one bucket are ranked.
    """
    hashed = df.withColumn("_hash", hash_order(id_col, seed)).withColumn(
        "_bucket", F.pmod(F.shiftrightunsigned("_hash", 20), F.lit(HASH_BUCKETS))
    )
    running = Window.partitionBy(group).orderBy("_bucket")
    limits = (
        hashed.groupBy(group, "_bucket")
        .agg(F.count("*").alias("_rows"), F.first(quota).alias("_quota"))
        .withColumn("_before", F.sum("_rows").over(running) - F.col("_rows"))
        .where(F.col("_before") < F.col("_quota"))
        .groupBy(group)
        .agg(
            F.max("_bucket").alias("_last"),
            (F.max("_quota") - F.max("_before")).alias("_room"),
        )
    )
    placed = hashed.join(limits, group).where(F.col("_bucket") <= F.col("_last"))
    whole = placed.where(F.col("_bucket") < F.col("_last"))
    rank = Window.partitionBy(group).orderBy("_hash", id_col)
    part = (
        placed.where(F.col("_bucket") == F.col("_last"))
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= F.col("_room"))
        .drop("_rank")
    )
    return whole.unionByName(part).select(*df.columns)
