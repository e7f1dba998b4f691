"""Sums of many numbers per row (Gram matrices, histograms, spectra).

Every task reduces its rows to one block of partial sums with NumPy; Spark adds
the blocks up by slot. Input splits are merged first so that the number of
blocks follows the cores of the cluster and not the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietband.functions.vectors import to_matrix
from quietband.session import partial_width

# Partial sums a task may hold before it passes them on.
MAX_HELD_SUMS = 16_000_000


def partial_sums(
    df: DataFrame,
    vector: str,
    slots: int,
    reduce_rows: Callable[[np.ndarray], np.ndarray],
    by: str | None = None,
    known: dict[int, np.ndarray] | None = None,
) -> DataFrame:
    """``(grp, slot, value)`` with ``reduce_rows`` summed over all rows per group.

    ``reduce_rows`` maps an (m, d) block to ``slots`` numbers that add up. With
    ``known`` it also gets what is known about the block's group.
    """
    group = F.lit(0) if by is None else F.col(by)
    rows = df.select(group.cast("long").alias("grp"), F.col(vector).alias("vec"))
    schema = "grp long, slot long, value double"

    def emit(held):
        for grp, sums in held.items():
            slot = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(slot), grp, dtype=np.int64)),
                    pa.array(slot.astype(np.int64)),
                    pa.array(sums[slot]),
                ],
                names=["grp", "slot", "value"],
            )

    def accumulate(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = to_matrix(batch.column(1))
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            for grp in np.unique(groups):
                if grp not in held:
                    if (len(held) + 1) * slots > MAX_HELD_SUMS and held:
                        yield from emit(held)
                        held = {}
                    held[grp] = np.zeros(slots)
                rows = matrix[groups == grp]
                held[grp] += reduce_rows(rows) if known is None else reduce_rows(rows, known[int(grp)])
        yield from emit(held)

    return (
        rows.coalesce(partial_width(df))
        .mapInArrow(accumulate, schema)
        .groupBy("grp", "slot")
        .agg(F.sum("value").alias("value"))
    )
