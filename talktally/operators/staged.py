"""Columns that are evaluated once per row, whatever is filtered on them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns, as `withColumns` does, and keep their expressions in one place.

    Catalyst moves a filter below a projection by copying the filtered column's
    expression into it, so parsing or shape tests would run again for every use.
    Columns that come out of an expanded one-row array have nothing to copy.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = df.select(*kept, F.array(F.struct(*[e.alias(n) for n, e in columns.items()])).alias("_row"))
    return packed.select(*kept, F.inline_outer("_row"))
