"""Expensive columns that later filters must not repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str | Column], **columns: Column) -> DataFrame:
    """``keep`` and the given columns, each evaluated once per row.

    A filter on a projected column is pushed below the projection together with
    the column's whole expression, which then runs twice. Columns that come out
    of a generator (here: exactly one row per input row) are not pushed.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(row)))
