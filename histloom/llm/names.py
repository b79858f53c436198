"""Column names that a table does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, base: str) -> str:
    """`base`, with as many underscores in front as it takes to be a new column name of `df`."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base
