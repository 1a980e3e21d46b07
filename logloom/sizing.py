"""Size checks that stand in front of everything that is copied to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_if_small(df: DataFrame, limit: int) -> list | None:
    """All rows when there are at most ``limit`` of them, else ``None``.

    Never brings more than ``limit + 1`` rows to the driver.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def is_small(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; stops counting beyond that."""
    return df.limit(limit + 1).count() <= limit


def lookup(
    df: DataFrame,
    dimension: DataFrame,
    key: str,
    value: str,
    target: str,
    default: str | None = None,
) -> DataFrame:
    """Add ``target`` = the dimension's ``value`` for ``key``.

    One left join at any size: adaptive execution broadcasts the dimension by its
    measured size or splits skewed partitions. Of several values for a key the
    smallest counts, so no row is doubled; a null key finds nothing.
    """
    other = dimension.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(target))
    found = F.coalesce(F.col(target), F.lit(default))
    return df.join(other, key, "left").select(*df.columns, found.alias(target))


def literal_lookup(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    """``values[key]`` as an expression, ``default`` when absent."""
    if not values:
        return F.lit(default).cast("string")
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
