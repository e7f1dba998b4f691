"""Helpers of the training-data operators: tables, stored stages, ranks, slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietband.session import ensure_checkpoint_dir

# Texts a task turns into Python objects at once, in bytes.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and go on from there."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Number all rows from 0 in the given order; no task sees more than one range of them."""
    placed = store(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    before = (
        placed.groupBy(part)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows"))
        .select("_part", "_before")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return (
        placed.withColumn("_part", F.shiftright("_at", 33))
        .join(before, "_part")
        .withColumn(rank, place)
        .drop("_part", "_at", "_before")
    )


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece stay near ``limit`` bytes (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size + 64
    if first < batch.num_rows:
        yield batch.slice(first)


def coded_words(texts: pa.Array, signs: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, the place there of each word in order, and the number of words of each text.

    ``signs`` says what becomes of each byte; words are what lies between blanks after that.
    """
    raws = texts.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    data = np.frombuffer((b" " + b" ".join(raws) + b" ").translate(signs), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    after = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)  # places between texts
    words_of = np.diff(np.searchsorted(starts, after), prepend=0)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), words_of
