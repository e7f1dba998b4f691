"""Parquet datasets and the numeric view of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietband.operators.profile import numeric_columns
from quietband.session import is_missing


def write_dataset(df: DataFrame, path: str) -> dict:
    """Write Parquet and describe what was written (counted from the files)."""
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    return {"path": path, "n_rows": written.count(), "n_columns": len(written.columns)}


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def numeric_matrix(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Numeric columns as doubles, without the rows where all of them are missing.

    ``keep`` names key columns that are carried along untouched.
    """
    keep = keep or []
    names = [c for c in numeric_columns(df) if c not in keep]
    rows = df
    if names:
        rows = df.where(~reduce(lambda a, b: a & b, [is_missing(df, c) for c in names]))
    return rows.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
