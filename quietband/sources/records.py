"""Records of delimited text whose quoted fields hold line breaks, read by many tasks.

Spark deals a text file out in byte ranges, each beginning at some line. Whether that
line starts a record depends on all quotes before it, so reading takes two passes. The
first finds, for each line and thus for each range, where it ends if it starts outside
quotes and where if it starts inside. Going through the ranges of a file in order then
fixes how each of them starts. In the second pass every range cuts its own lines into
records; what a range boundary cuts apart is put together by range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietband.session import check_broadcast, cut_lineage

OUTSIDE, INSIDE = 0, 1
WHOLE, GOES_ON, BEGINS = 0, 1, 2


def text_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``(line, file, start)`` in the order of the file within each ``start`` of a byte range."""
    line = F.col("value")
    if encoding != "UTF-8":
        line = F.decode(line.cast("binary"), encoding)
    return spark.read.option("lineSep", "\n").text(path).select(
        line.alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def ends_inside(line: Column, sep: str) -> Column:
    """Whether a line that starts outside quotes ends inside them.

    Quotes open at the start of a field only; doubled ones inside are text.
    """
    opening = f"(^|{re.escape(sep)})\""
    rest = F.regexp_replace(line, '""', "")
    return F.regexp_replace(rest, f'{opening}[^"]*"', "$1").rlike(opening)


def _with_ends(lines: DataFrame, sep: str) -> DataFrame:
    """Add how each line ends (0 or 1) when it starts outside and when it starts inside."""
    quoted = F.contains("line", F.lit('"'))
    return lines.withColumns(
        {
            "from_outside": F.when(quoted, ends_inside(F.col("line"), sep).cast("int")).otherwise(OUTSIDE),
            "from_inside": F.when(
                quoted, ends_inside(F.concat(F.lit('"x'), "line"), sep).cast("int")
            ).otherwise(INSIDE),
        }
    )


def states(first: int, from_outside: np.ndarray, from_inside: np.ndarray) -> np.ndarray:
    """State after each line: set by the last line that ends alike from both, turned by those since."""
    place = np.arange(len(from_outside))
    fixed = np.maximum.accumulate(np.where(from_outside == from_inside, place, -1))
    turns = np.cumsum(from_outside > from_inside)
    since = turns - np.where(fixed >= 0, turns[fixed], 0)
    return np.where(fixed >= 0, from_outside[fixed], first) ^ (since & 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Cut a batch where the byte range changes."""
    files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    code = files.indices.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (starts[1:] != starts[:-1])) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield (files.dictionary[int(code[a])].as_py(), int(starts[a])), batch.slice(a, b - a)


def _ranges(lines: DataFrame) -> DataFrame:
    """``(file, start, from_outside, from_inside)``: how each byte range ends."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], tuple[int, int]] = {}
        for batch in batches:
            for key, run in _runs(batch):
                maps = run.column(2).to_numpy(), run.column(3).to_numpy()
                ends[key] = tuple(
                    int(states(s, *maps)[-1]) for s in ends.get(key, (OUTSIDE, INSIDE))
                )
        columns = [
            pa.array([k[0] for k in ends], pa.string()),
            pa.array([k[1] for k in ends], pa.int64()),
            pa.array([v[0] for v in ends.values()], pa.int32()),
            pa.array([v[1] for v in ends.values()], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "from_outside", "from_inside"])

    columns = ["file", "start", "from_outside", "from_inside"]
    return lines.select(*columns).mapInArrow(follow, "file string, start long, from_outside int, from_inside int")


def _starts(ranges: DataFrame) -> dict[tuple[int, int], int]:
    """How each byte range starts, by the hash of its file and its place in the file.

    A range maps states like a line does, so the same rule applies along a file's ranges.
    """
    along = Window.partitionBy("file").orderBy("start")
    so_far = along.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")
    turned = (F.col("from_outside") > F.col("from_inside")).cast("int")
    placed = ranges.withColumns(
        {
            "turns": F.coalesce(F.sum(turned).over(so_far), F.lit(0)),
            "turns_after": F.sum(turned).over(along.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).withColumns(
        {
            "state": F.coalesce(
                F.last(F.when(fixed, F.col("from_outside")), ignorenulls=True).over(so_far), F.lit(OUTSIDE)
            ),
            "since": F.coalesce(
                F.last(F.when(fixed, F.col("turns_after")), ignorenulls=True).over(so_far), F.lit(0)
            ),
        }
    )
    state = F.col("state").bitwiseXOR((F.col("turns") - F.col("since")).cast("int") % 2)
    rows = placed.select(F.xxhash64("file").alias("file"), "start", state.alias("state"))
    check_broadcast(rows.count(), 24, "the list of byte ranges")
    return {(r["file"], r["start"]): r["state"] for r in rows.collect()}


def quoted_records(lines: DataFrame, sep: str, header: bool) -> DataFrame:
    """``record``: one row per record, line breaks inside quotes included.

    With ``header`` the first record of every file is left out. The number of byte ranges,
    not that of records, is bounded by what may be sent to all tasks.
    """
    lines = _with_ends(lines, sep)
    known = cut_lineage(_ranges(lines))
    shared = lines.sparkSession.sparkContext.broadcast(_starts(known))
    keyed = lines.select("file", "start", "from_outside", "from_inside", "line", F.xxhash64("file").alias("key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state, part, first = None, [], OUTSIDE, WHOLE, False
        for batch in batches:
            for key, run in _runs(batch):
                if key != at:
                    if held and not first:
                        yield _pieces(at, [("\n".join(held), GOES_ON if part == GOES_ON else BEGINS)])
                    state = shared.value[run.column(5)[0].as_py(), key[1]]
                    at, held, part = key, [], GOES_ON if state == INSIDE else WHOLE
                    first = header and key[1] == 0
                after = states(state, run.column(2).to_numpy(), run.column(3).to_numpy())
                text = run.column(4).to_pylist()
                found = []
                begin = 0
                for end in np.flatnonzero(after == OUTSIDE).tolist():
                    lines_of = text[begin : end + 1]
                    record = "\n".join([*held, *lines_of]) if held or len(lines_of) > 1 else lines_of[0]
                    begin, held = end + 1, []
                    if first:
                        first = False
                    else:
                        found.append((record, part))
                    part = WHOLE
                held += text[begin:]
                state = int(after[-1])
                if found:
                    yield _pieces(at, found)
        if held and not first:
            yield _pieces(at, [("\n".join(held), GOES_ON if part == GOES_ON else BEGINS)])

    pieces = cut_lineage(keyed.mapInArrow(cut, "file string, start long, part int, record string"))
    # A piece that goes on belongs to the last record that began in a range before it.
    along = Window.partitionBy("file").orderBy("start", "part")
    broken = pieces.where(F.col("part") != WHOLE).withColumn(
        "owner", F.last(F.when(F.col("part") == BEGINS, F.col("start")), ignorenulls=True).over(along)
    )
    in_order = F.array_sort(F.collect_list(F.struct("start", "record")))
    joined = broken.where("owner is not null").groupBy("file", "owner").agg(
        F.array_join(F.transform(in_order, lambda p: p["record"]), "\n").alias("record")
    )
    whole = pieces.where(F.col("part") == WHOLE).select("record").unionByName(joined.select("record"))
    return whole.select(F.regexp_replace("record", r"\r\z", "").alias("record"))


def _pieces(key: tuple[str, int], found: list[tuple[str, int]]) -> pa.RecordBatch:
    first = pa.array(np.zeros(len(found), np.int32))
    columns = [
        pa.array([key[0]]).take(first),
        pa.array([key[1]], pa.int64()).take(first),
        pa.array([part for _, part in found], pa.int32()),
        pa.array([record for record, _ in found], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["file", "start", "part", "record"])
