"""Column naming rules for imported tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cleaned_names(names: list[str]) -> list[str]:
    """Lower case with underscores, blanks numbered by position, repeats by count."""
    repeats: dict[str, int] = {}
    result = []
    for position, raw in enumerate(names):
        name = raw.strip().lower().replace(" ", "_")
        if name == "" or name.startswith("unnamed"):
            name = f"col_{position}"
        count = repeats.get(name)
        repeats[name] = 0 if count is None else count + 1
        result.append(name if count is None else f"{name}_{count + 1}")
    return result


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*cleaned_names(df.columns))
