"""Labelled texts for training: a bounded sample, chosen by hash so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows a model is fitted on at most.
MAX_LABELLED = 20_000


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold kept for checking; NULL ids do not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_texts(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    fold: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = MAX_LABELLED,
) -> DataFrame:
    """``(id, text, label)`` of at most ``limit`` labelled rows outside the held-out fold.

    Rows without a label are left out; of several labels for one id the smallest counts.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(F.col(label)).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(limit)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label")
