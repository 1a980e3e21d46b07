"""Incremental and pending work, and batch deletion."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULT_EVENTS
from ..sizing import is_small, rows_if_small
from .features import pivot_counts


def pending_batches(stats: DataFrame, done: DataFrame) -> DataFrame:
    """Batches that were never processed.

    An anti join, so a null id on the right does not hide all of them. ``done``
    is the ledger of processed batches, which also knows batches without any
    anomaly.
    """
    return stats.select("batch_id").distinct().join(done.select("batch_id").distinct(), "batch_id", "left_anti")


def incremental_features(
    stats: DataFrame,
    mark: Column,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    broadcast_blocks: int = 200_000,
) -> DataFrame:
    """Full-history counts of the blocks touched after ``mark``.

    Few touched blocks: their ids are broadcast and everything else is dropped
    before the shuffle. Many: one aggregation over all blocks keeps those whose
    newest row is after the mark, which is the same set without a join. Rows
    without a block are left out either way.
    """
    stats = stats.where(F.col("block_id").isNotNull())
    touched = stats.where(F.col("last_updated") > mark).select("block_id").distinct()
    newest = [F.max("last_updated").alias("last_updated")]
    if is_small(touched, broadcast_blocks):
        history = stats.join(F.broadcast(touched), "block_id", "left_semi")
        return pivot_counts(history, event_ids, extra=newest)
    return pivot_counts(stats, event_ids, extra=newest).where(F.col("last_updated") > mark)


def store_bucketed(stats: DataFrame, table: str, buckets: int = 200, path: str | None = None) -> None:
    """Append counts to a table that is bucketed and sorted by block.

    Each append is shuffled once, into one file for each bucket; whatever is
    summed by block later reads the buckets as they lie.
    """
    dealt = stats.repartition(buckets, "block_id")
    writer = dealt.write.mode("append").format("parquet").bucketBy(buckets, "block_id").sortBy("block_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def incremental_features_stored(
    spark: SparkSession,
    table: str,
    mark: Column,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    listed: int = 1_000,
) -> DataFrame:
    """``incremental_features`` over a table of ``store_bucketed``, without an exchange of its rows.

    Each task sums whole buckets and keeps the blocks that were touched after
    the mark. At most ``listed`` touched blocks are named in a filter, which
    also prunes the buckets that hold none of them.
    """
    stats = spark.table(table).where(F.col("block_id").isNotNull())
    touched = rows_if_small(stats.where(F.col("last_updated") > mark).select("block_id").distinct(), listed)
    if touched is not None:
        stats = stats.where(F.col("block_id").isin([r[0] for r in touched]))
    wide = pivot_counts(stats, event_ids, extra=[F.max("last_updated").alias("last_updated")])
    return wide.where(F.col("last_updated") > mark)


def high_water_mark(df: DataFrame, time: str = "last_updated") -> DataFrame:
    return df.agg(F.max(time).alias("mark"))


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


#: Partitions that one statement drops.
PARTITIONS = 500

DELETED = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def delete_batches(
    spark: SparkSession, tables: Sequence[str], batch_ids: Sequence[str], confirm: bool = False
) -> DataFrame:
    """Drop the batches' partitions from catalog tables (N1); a failure does not stop the rest.

    One statement drops up to ``PARTITIONS`` batches of a table. If it fails, its
    batches are dropped one by one, so that the report names the one at fault.
    """
    if not confirm:
        raise ValueError("deleting batches needs confirm=True")
    good = [b for b in batch_ids if re.fullmatch(r"[\w.-]+", b)]
    done: dict[tuple[str, str], tuple[bool, str | None]] = {}

    def drop(table: str, some: Sequence[str]) -> None:
        listed = ", ".join(f"PARTITION (batch_id = '{b}')" for b in some)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {listed}")

    for table in tables:
        for at in range(0, len(good), PARTITIONS):
            some = good[at : at + PARTITIONS]
            try:
                drop(table, some)
                done |= {(b, table): (True, None) for b in some}
            except Exception:  # one batch's failure is part of the report
                for batch in some:
                    try:
                        drop(table, [batch])
                        done[batch, table] = (True, None)
                    except Exception as error:
                        done[batch, table] = (False, str(error))
    report = []
    for batch in batch_ids:
        named = [(batch, table, *done[batch, table]) for table in tables if (batch, table) in done]
        report += named or [(batch, None, False, "not a batch id")]
    return spark.createDataFrame(report, DELETED)


def delete_all_batches(spark: SparkSession, tables: Sequence[str], confirm: bool = False) -> DataFrame:
    """Drop every batch of the first table from all of them.

    Reads the catalog's partition list, not the data.
    """
    ids = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {tables[0]}").toLocalIterator()]
    return delete_batches(spark, tables, ids, confirm)
