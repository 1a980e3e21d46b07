"""Places of rows in their files, over any number of files and splits (S3, K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_once


def numbered(rows: DataFrame, name: str = "line_no", once: bool = False) -> DataFrame:
    """Add the 0-based place of every row over all input files, files in order of their paths.

    ``rows`` comes straight from a file reader. Rows are counted by split in a
    first pass; a running sum over the splits, one row for each, then gives the
    place of a split's first row. No row is moved or sorted. With ``once`` the
    input is read a single time and kept in the scratch folder: for very many
    small files, which cost more to open than to copy.
    """
    origin = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    if once:
        # Tasks that each open a few small files would leave as many small files again.
        origin = written_once(origin.coalesce(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "numbered")
    splits = origin.groupBy("_file", "_start").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return origin.join(offsets, ["_file", "_start"]).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias(name))
