"""Column standardisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietband.operators.profile import TINY_STD, impute_zero, validate


@dataclass(frozen=True)
class NormParams:
    """Mean and effective standard deviation of each column."""

    columns: list[str]
    means: list[float]
    stds: list[float]

    def to_df(self, spark) -> DataFrame:
        rows = list(zip(range(len(self.columns)), self.columns, self.means, self.stds))
        return spark.createDataFrame(rows, "position int, feature string, mean double, std double")


def norm_params(df: DataFrame, columns: list[str]) -> NormParams:
    """Moments ignoring NULL and NaN; a flat or empty column gets std 1."""
    aggregates = []
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`").cast("double")
        known = F.when(~F.isnan(value), value)
        aggregates += [F.avg(known).alias(f"m{i}"), F.stddev_pop(known).alias(f"s{i}")]
    row = df.agg(*aggregates).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
    stds = [row[f"s{i}"] or 0.0 for i in range(len(columns))]
    return NormParams(list(columns), means, [1.0 if s < TINY_STD else s for s in stds])


def apply_standardize(df: DataFrame, params: NormParams) -> DataFrame:
    return df.withColumns(
        {
            c: (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s)
            for c, m, s in zip(params.columns, params.means, params.stds)
        }
    )


def standardize(df: DataFrame, columns: list[str]) -> tuple[DataFrame, NormParams]:
    """Zero mean and unit variance; NULL and NaN stay as they are."""
    params = norm_params(df, columns)
    return apply_standardize(df, params), params


def inverse_standardize(df: DataFrame, params: NormParams) -> DataFrame:
    return df.withColumns(
        {
            c: F.col(f"`{c}`") * F.lit(s) + F.lit(m)
            for c, m, s in zip(params.columns, params.means, params.stds)
        }
    )


def ingest(df: DataFrame, id_col: str, columns: list[str]):
    """Validate, standardise and impute: the cleaned table, its parameters, the quality row."""
    quality = validate(df, columns)
    scaled, params = standardize(df.select(id_col, *columns), columns)
    return impute_zero(scaled, columns), params, quality
