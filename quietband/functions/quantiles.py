"""Exact quantiles of whole columns without gathering them in one task.

``percentile`` keeps every distinct value of a column in one aggregation
buffer. Here an approximate sketch proposes two values around each wanted rank;
the rows below, at, between and above them are counted, which either settles the
rank or leaves an open interval without the two values. So every round makes
progress whatever ties the column holds, and the last rows are counted by value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
# Rows of one bracket the driver reads at most, counted by value.
MAX_BRACKET_ROWS = 20_000
# Rank error allowed for when the sketch is asked for values around a rank.
MARGIN = 2.0 / SKETCH_ACCURACY


@dataclass
class _Rank:
    """One wanted rank of one column and the open interval that holds it."""

    name: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    def within(self, column: Column) -> Column:
        held = column.isNotNull()
        if self.low is not None:
            held = held & (column > self.low)
        if self.high is not None:
            held = held & (column < self.high)
        return held

    def points(self) -> list[float]:
        middle = (self.rank - self.below) / max(self.inside - 1, 1)
        return [max(middle - MARGIN, 0.0), min(middle + MARGIN, 1.0)]

    def narrow(self, a: float, b: float, under: int, at_a: int, between: int, at_b: int) -> None:
        """Settle the rank at ``a`` or ``b``, or go on in the interval beside or between them."""
        place = self.rank - self.below
        if place < under:
            self.high, self.inside = a, under
        elif place < under + at_a:
            self.value = a
        elif place < under + at_a + between:
            self.low, self.high, self.below, self.inside = a, b, self.below + under + at_a, between
        elif place < under + at_a + between + at_b:
            self.value = b
        else:
            passed = under + at_a + between + at_b
            self.low, self.below, self.inside = b, self.below + passed, self.inside - passed


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each named expression.

    NULL and NaN are ignored; a column without values gives ``None``.
    """
    names = list(columns)
    clean = df.select(
        *[
            F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"v{i}")
            for i, c in enumerate(columns.values())
        ]
    )
    column_of = {name: F.col(f"v{i}") for i, name in enumerate(names)}
    totals = clean.agg(*[F.count(c).alias(n) for n, c in column_of.items()]).first()
    ranks: dict[tuple[str, int], _Rank] = {}
    for name in names:
        for prob in probs if totals[name] else []:
            position = (totals[name] - 1) * prob
            for rank in (math.floor(position), math.ceil(position)):
                ranks.setdefault((name, rank), _Rank(name, rank, totals[name]))

    pending = list(ranks.values())
    while pending:
        _narrow(clean, column_of, [r for r in pending if r.inside > MAX_BRACKET_ROWS])
        pending = [r for r in pending if r.value is None]
        _read_brackets(clean, column_of, [r for r in pending if r.inside <= MAX_BRACKET_ROWS])
        pending = [r for r in pending if r.value is None]

    def interpolated(name: str, prob: float) -> float | None:
        if not totals[name]:
            return None
        position = (totals[name] - 1) * prob
        low, high = (ranks[name, f(position)].value for f in (math.floor, math.ceil))
        return low + (high - low) * (position - math.floor(position)) if low != high else low

    return {name: [interpolated(name, prob) for prob in probs] for name in names}


def _by_bracket(ranks: list[_Rank]) -> list[list[_Rank]]:
    groups: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        groups.setdefault((r.name, r.low, r.high), []).append(r)
    return list(groups.values())


def _narrow(clean: DataFrame, column_of, ranks: list[_Rank]) -> None:
    """One sketch and one count over all intervals that still hold many rows."""
    if not ranks:
        return
    groups = _by_bracket(ranks)
    row = clean.agg(
        *[
            F.percentile_approx(
                F.when(group[0].within(column_of[group[0].name]), column_of[group[0].name]),
                F.array(*[F.lit(p) for r in group for p in r.points()]),
                SKETCH_ACCURACY,
            ).alias(f"s{i}")
            for i, group in enumerate(groups)
        ]
    ).first()
    asked, aggregates = [], []
    for i, group in enumerate(groups):
        for j, r in enumerate(group):
            a, b = row[f"s{i}"][2 * j : 2 * j + 2]
            column, held, k = column_of[r.name], r.within(column_of[r.name]), len(asked)
            parts = (column < a, column == a, (column > a) & (column < b), (column == b) & F.lit(a != b))
            aggregates += [F.count_if(held & part).alias(f"c{k}_{n}") for n, part in enumerate(parts)]
            asked.append((r, a, b))
    counts = clean.agg(*aggregates).first()
    for k, (r, a, b) in enumerate(asked):
        r.narrow(a, b, *[counts[f"c{k}_{n}"] for n in range(4)])


def _read_brackets(clean: DataFrame, column_of, ranks: list[_Rank]) -> None:
    """Count the rows inside small intervals by value and pick the wanted ranks."""
    if not ranks:
        return
    groups = _by_bracket(ranks)
    inside = F.array(
        *[
            F.when(
                group[0].within(column_of[group[0].name]),
                F.struct(F.lit(i).alias("q"), column_of[group[0].name].alias("v")),
            )
            for i, group in enumerate(groups)
        ]
    )
    rows = (
        clean.select(F.explode(F.array_compact(inside)).alias("k"))
        .groupBy("k.q", "k.v")
        .agg(F.count("*").alias("rows"))
        .collect()
    )
    counts: list[list] = [[] for _ in groups]
    for r in sorted((r["q"], r["v"], r["rows"]) for r in rows):
        counts[r[0]].append(r[1:])
    for group, counted in zip(groups, counts):
        for r in group:
            r.value = _at(counted, r.rank - r.below)


def _at(counts: list[tuple[float, int]], rank: int) -> float:
    for value, count in counts:
        rank -= count
        if rank < 0:
            return value
    raise IndexError("rank beyond the counted values")


def approx_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float], accuracy: int = SKETCH_ACCURACY
) -> dict[str, list[float | None]]:
    """One-pass sketch with rank error ``1 / accuracy``."""
    row = df.agg(
        *[
            F.percentile_approx(
                F.when(~F.isnan(c.cast("double")), c.cast("double")),
                F.array(*map(F.lit, probs)),
                accuracy,
            ).alias(f"s{i}")
            for i, c in enumerate(columns.values())
        ]
    ).first()
    return {
        name: list(row[f"s{i}"]) if row[f"s{i}"] is not None else [None] * len(probs)
        for i, name in enumerate(columns)
    }
