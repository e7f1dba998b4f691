"""Harmonic packing of tokenized documents into sequences of one length.

A piece belongs to class k when k of its length fit into a sequence but k + 1 do
not. Each class fills its own sequences with exactly k pieces, so a worker only
needs the number of pieces before its own to know where they go: no shared bins,
no search. Cutting is free, so documents are cut at class lengths until the rest
is short; only the rest leaves padding, at most 1 / (k + 1) of its own length.
The few pieces of the last, unfilled sequence of each class (a number bounded by
the sequence length, not by the data) are laid end to end and cut again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietband.llm.common import slices, store
from quietband.llm.tokens import TEXT_BYTES, WordEncoder

CAPACITY = 4096
# Rests below this length are not cut further: they fill classes whose padding is small.
SHORT = 128
# Pieces per salt on average, over all classes.
GROUP_PIECES = 1_000_000
MIN_GROUPS = 32


def cut_lengths(tokens: int, capacity: int = CAPACITY, short: int = SHORT) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then class lengths, then the rest."""
    lengths = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest >= short:
        share = -(-capacity // rest)
        lengths.append(capacity // share)
        rest -= capacity // share
    return lengths + [rest] if rest else lengths


def tokenized_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``, one row per piece.

    A NULL text is empty and gives the end id alone; NULL ids stay NULL.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids binary" if keep_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows: list[list] = [[] for _ in range(6)]
                end = np.array([end_id], encoder.dtype).tobytes()
                for i, found in enumerate(encoder.encode_raw(texts)):
                    ids = np.frombuffer(found + end, encoder.dtype).astype("<u4")
                    at = 0
                    for length in cut_lengths(len(ids), capacity):
                        raw = ids[at : at + length].tobytes()
                        for column, value in zip(rows, (i, at, length, zlib.crc32(raw), len(ids), raw)):
                            column.append(value)
                        at += length
                columns = [part.column(0).take(pa.array(rows[0], pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in rows[1:5]]
                columns += [pa.array(rows[5], pa.binary())] if keep_ids else []
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def harmonic_pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0) to pieces with a ``length``.

    Lengths must lie between 1 and ``capacity``. Equal rows are told apart by the
    place they are stored at. An empty table gives an empty result.
    """
    pieces = store(
        pieces.withColumn("_class", F.floor(F.lit(capacity) / F.col("length")).cast("long")).withColumn(
            "_row", F.monotonically_increasing_id()
        ),
        "pieces",
    )
    groups = max(MIN_GROUPS, pieces.count() // GROUP_PIECES)
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    sizes = salted.groupBy("_class", "_group").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_class").orderBy("_group")) - F.col("_rows")
    starts = store(sizes.withColumn("_before", before), "starts")
    bins = starts.groupBy("_class").agg(
        F.floor(F.sum("_rows") / F.col("_class")).cast("long").alias("_full")
    )
    bins = bins.withColumn("_first", F.sum("_full").over(Window.orderBy("_class")) - F.col("_full"))
    bins = store(bins, "bins")  # one row per class, never more than ``capacity``
    within = Window.partitionBy("_class", "_group").orderBy("_row")
    ranked = (
        salted.join(starts.drop("_rows"), ["_class", "_group"])
        .withColumn("_rank", F.row_number().over(within) - 1 + F.col("_before"))
        .join(F.broadcast(bins), "_class")
        .withColumn("_bin", F.floor(F.col("_rank") / F.col("_class")).cast("long"))
    )
    columns = [c for c in pieces.columns if c not in ("_class", "_row")]
    inside = Window.partitionBy("sequence_id").orderBy("_rank")
    whole = (
        ranked.where(F.col("_bin") < F.col("_full"))
        .withColumn("sequence_id", F.col("_first") + F.col("_bin"))
        .withColumn("offset", F.sum("length").over(inside) - F.col("length"))
        .select(*columns, "sequence_id", "offset")
    )
    used = bins.agg(F.coalesce(F.sum("_full"), F.lit(0)).alias("_used"))
    rest = ranked.where(F.col("_bin") == F.col("_full")).select("_row", "length")
    placed = rest.join(F.broadcast(used)).groupBy("_used").applyInArrow(
        _fill_last(capacity), "_row long, sequence_id long, offset long"
    )
    tail = pieces.join(F.broadcast(placed), "_row").select(*columns, "sequence_id", "offset")
    return whole.unionByName(tail)


def _fill_last(capacity: int):
    """First-fit by falling length for the unfilled last sequences of all classes."""

    def fill(rest: pa.Table) -> pa.Table:
        length = rest["length"].to_numpy()
        order = np.lexsort((rest["_row"].to_numpy(), -length))
        room = np.zeros(0, dtype=np.int64)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for i in order:
            fits = room >= length[i]
            at = int(fits.argmax()) if fits.any() else len(room)
            if at == len(room):
                room = np.append(room, capacity)
            sequence[i], offset[i] = at, capacity - room[at]
            room[at] -= length[i]
        used = rest["_used"].to_numpy()
        return pa.table({"_row": rest["_row"], "sequence_id": sequence + used, "offset": offset})

    return fill
