"""Session helpers: lineage cuts, bounded broadcasts and stage persistence."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table this library broadcasts on purpose, in bytes of payload.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quietband-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Tables defined and cut inside lose the shuffle files that led to their written copies at once.

    Otherwise these stay on the disks until the driver collects garbage. What is defined
    inside should be run once only, as its shuffles would be written anew.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def check_broadcast(rows: int, bytes_per_row: int, what: str) -> None:
    """Refuse to ship a model table that is not small."""
    if rows * bytes_per_row > MAX_BROADCAST_BYTES:
        raise ValueError(
            f"{what} needs {rows * bytes_per_row} bytes on every executor, "
            f"above the limit of {MAX_BROADCAST_BYTES}"
        )


def partial_width(df: DataFrame) -> int:
    """Number of tasks that should build partial aggregates.

    A partial sum of d x d numbers per task is only worth shipping a few times
    per core, so the input splits are merged (without a shuffle) to this width.
    """
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def is_missing(df: DataFrame, name: str):
    """NULL for every type, NaN as well for floating point columns."""
    column = F.col(f"`{name}`")
    if dict(df.dtypes)[name] in ("double", "float"):
        return column.isNull() | F.isnan(column)
    return column.isNull()
