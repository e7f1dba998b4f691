"""Column profiling, import suitability and input validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietband.session import is_missing

SAMPLE_SIZE = 5
PREVIEW_WIDTH = 50
MISSING_MARK = "—"
TINY_STD = 1e-10


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "numeric"]


def _known(df: DataFrame, name: str) -> Column:
    return ~is_missing(df, name)


def column_info(df: DataFrame, order_col: str) -> DataFrame:
    """One row per column: kind, missing count and share, first sample values.

    Samples are the first non-missing values in the order of ``order_col``.
    """
    blanks = {
        f.name: (F.col(f"`{f.name}`") == "") if kind_of(f.dataType) == "string" else F.lit(False)
        for f in df.schema.fields
    }
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(is_missing(df, c) | blanks[c]).alias(f"m{i}")
            for i, c in enumerate(df.columns)
        ],
    )
    described = counts.select(
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(f.name).alias("name"),
                        F.lit(kind_of(f.dataType)).alias("kind"),
                        F.col(f"m{i}").alias("missing_count"),
                    )
                    for i, f in enumerate(df.schema.fields)
                ]
            )
        ).alias("c"),
    ).select("n", "c.*")
    return (
        described.join(F.broadcast(_samples(df, order_col)), "position", "left")
        .select(
            "position",
            "name",
            "kind",
            (F.col("kind") == "numeric").alias("is_numeric"),
            F.col("missing_count").cast("long").alias("missing_count"),
            F.round(100.0 * F.col("missing_count") / F.greatest("n", F.lit(1)), 2).alias(
                "missing_pct"
            ),
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        )
        .orderBy("position")
    )


def _samples(df: DataFrame, order_col: str) -> DataFrame:
    """First values per column: two columns are read for each, and a handful of rows kept."""
    order = F.col(f"`{order_col}`")
    parts = []
    for i, name in enumerate(df.columns):
        text = F.col(f"`{name}`").cast("string").alias("value")
        held = df.where(_known(df, name)).select(F.lit(i).alias("position"), order.alias("_order"), text)
        parts.append(held.orderBy("_order", "value").limit(SAMPLE_SIZE))
    rank = Window.partitionBy("position").orderBy("_order", "value")
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("rank", F.row_number().over(rank))
        .groupBy("position")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("s"))
        .select("position", F.col("s.value").alias("samples"))
    )


def preview(df: DataFrame, order_col: str, n: int = 100) -> DataFrame:
    """First ``n`` rows as short strings; missing values become a dash."""
    head = df.orderBy(F.col(f"`{order_col}`")).limit(n)
    return head.select(
        *[
            F.when(is_missing(df, c), F.lit(MISSING_MARK))
            .otherwise(F.substring(F.col(f"`{c}`").cast("string"), 1, PREVIEW_WIDTH))
            .alias(c)
            for c in df.columns
        ]
    )


def _missing_share(df: DataFrame) -> Column:
    holes = F.array_compact(F.array(*[F.when(is_missing(df, c), 1) for c in df.columns]))
    return F.coalesce(F.avg(F.size(holes) / F.lit(len(df.columns))), F.lit(0.0))


def missing_percentage(df: DataFrame) -> DataFrame:
    """Share of NULL/NaN cells over the whole table, in percent."""
    return df.agg((_missing_share(df) * 100.0).alias("missing_pct"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first occurrence of each distinct row, counted exactly."""
    return (
        df.groupBy(*[F.col(f"`{c}`") for c in df.columns])
        .agg(F.count(F.lit(1)).alias("_copies"))
        .agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def _constant(df: DataFrame, name: str) -> Column:
    value = F.when(_known(df, name), F.col(f"`{name}`"))
    return (F.count(value) > 0) & (F.min(value) == F.max(value))


def _names_where(names: list[str], flag_prefix: str) -> Column:
    flagged = F.array(
        *[F.when(F.col(f"{flag_prefix}{i}"), F.lit(c)) for i, c in enumerate(names)]
    )
    return F.array_compact(flagged) if names else F.array().cast("array<string>")


def constant_columns(df: DataFrame) -> DataFrame:
    """Numeric columns that hold one single non-missing value, one row each."""
    names = numeric_columns(df)
    flags = df.agg(*[_constant(df, c).alias(f"k{i}") for i, c in enumerate(names)])
    return flags.select(F.explode(_names_where(names, "k")).alias("name"))


def suitability(stats: DataFrame) -> DataFrame:
    """Add score, level and warnings to a row of import statistics.

    Needs ``n_rows, n_numeric, missing_pct, duplicate_rows, n_constant``.
    """
    rows, numeric = F.col("n_rows"), F.col("n_numeric")
    missing, constant = F.col("missing_pct"), F.col("n_constant")
    dup_pct = F.col("duplicate_rows") * 100.0 / F.greatest(rows, F.lit(1))
    rules = [
        (rows < 100, F.lit(0.4), F.format_string("only %d rows, at least 100 advised", rows)),
        (
            (rows >= 100) & (numeric > 0) & (rows < 10 * numeric),
            F.lit(0.2),
            F.format_string("only %d rows for %d numeric columns, 10 per column advised", rows, numeric),
        ),
        (numeric == 0, F.lit(1.0), F.lit("no numeric column, at least 3 needed")),
        (
            numeric.between(1, 2),
            F.lit(0.5),
            F.format_string("only %d numeric column(s), at least 3 needed", numeric),
        ),
        (missing > 10, F.lit(0.3), F.format_string("%.1f%% missing values, large gaps", missing)),
        (
            (missing > 1) & (missing <= 10),
            F.lit(0.1),
            F.format_string("%.1f%% missing values, will be imputed", missing),
        ),
        (dup_pct > 10, F.lit(0.1), F.format_string("%.1f%% duplicate rows", dup_pct)),
        (
            constant > 0,
            F.least(constant * 0.05, F.lit(0.2)),
            F.format_string("%d constant column(s)", constant),
        ),
    ]
    deducted = sum((F.when(hit, cost).otherwise(0.0) for hit, cost, _ in rules), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - deducted))
    # Deductions leave rounding dust right at the level boundaries.
    rounded = F.round(score, 9)
    return stats.select(
        "*",
        F.round(score, 3).alias("suitability_score"),
        F.when(rounded >= 0.7, "ready")
        .when(rounded >= 0.4, "needs_attention")
        .otherwise("not_suitable")
        .alias("suitability_level"),
        F.array_compact(F.array(*[F.when(hit, text) for hit, _, text in rules])).alias("warnings"),
    )


def profile(df: DataFrame) -> DataFrame:
    """One-row import report: one aggregate scan plus the duplicate grouping."""
    names = numeric_columns(df)
    stats = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (_missing_share(df) * 100.0).alias("missing_pct"),
        *[_constant(df, c).alias(f"k{i}") for i, c in enumerate(names)],
    ).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(names)).alias("n_numeric"),
        F.lit(len(df.columns) - len(names)).alias("n_non_numeric"),
        "missing_pct",
        _names_where(names, "k").alias("constant_columns"),
    )
    joined = stats.withColumn("duplicate_rows", duplicate_rows(df).scalar())
    scored = suitability(joined.withColumn("n_constant", F.size("constant_columns")))
    return scored.withColumn("missing_pct", F.round("missing_pct", 2)).drop("n_constant")


class InvalidInput(ValueError):
    """The table cannot be analysed at all."""


def validate(df: DataFrame, feature_cols: list[str] | None = None) -> DataFrame:
    """Quality row of a numeric table; raises when it cannot be analysed."""
    names = list(feature_cols or df.columns)
    data = df.select(*[F.col(f"`{c}`") for c in names])
    wrong = [c for c in names if c not in numeric_columns(data)]
    if wrong:
        raise InvalidInput(f"columns are not numeric: {wrong}")
    if len(names) < 2:
        raise InvalidInput(f"at least 2 columns are needed, got {len(names)}")
    numbers = data.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    known = {c: F.when(_known(numbers, c), F.col(f"`{c}`")) for c in names}
    infinite = [F.count_if(F.abs(known[c]) == float("inf")) for c in names]
    stats = numbers.agg(
        F.count(F.lit(1)).alias("n_samples"),
        _missing_share(numbers).alias("_missing"),
        sum(infinite, F.lit(0)).alias("_infinite"),
        *[F.coalesce(F.stddev_pop(known[c]) < TINY_STD, F.lit(True)).alias(f"k{i}") for i, c in enumerate(names)],
    ).first()
    if stats["n_samples"] < 2:
        raise InvalidInput(f"at least 2 rows are needed, got {stats['n_samples']}")
    if stats["_infinite"]:
        raise InvalidInput(f"{stats['_infinite']} infinite values")
    flat = [i for i in range(len(names)) if stats[f"k{i}"]]
    n, d = F.lit(stats["n_samples"]), F.lit(len(names))
    missing = F.lit(float(stats["_missing"]))
    score = (
        1.0
        - 0.5 * missing
        - 0.3 * F.lit(len(flat) / len(names))
        - 0.2 * F.col("duplicate_rows") / n
    )
    return duplicate_rows(numbers).select(
        n.cast("long").alias("n_samples"),
        d.alias("n_features"),
        (missing * 100.0).alias("missing_pct"),
        F.col("duplicate_rows").alias("duplicate_count"),
        F.lit(flat).cast("array<int>").alias("constant_dims"),
        (n >= 10 * d).alias("enough_samples"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("suitability_score"),
    )


def impute_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL and NaN become 0, the mean of a standardised column."""
    return df.withColumns(
        {c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    )
