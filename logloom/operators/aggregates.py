"""Whole-table aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import batch_risk, batch_time


def total_blocks(stats: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct blocks; exact unless asked otherwise."""
    count = F.approx_count_distinct("block_id") if approximate else F.count_distinct("block_id")
    return stats.agg(count.alias("total_blocks"))


def event_distribution(stats: DataFrame) -> DataFrame:
    """Total count per event, most frequent first."""
    return (
        stats.groupBy("event_id")
        .agg(F.sum("cnt").alias("total_count"))
        .orderBy(F.desc("total_count"), "event_id")
    )


def distribution_map(distribution: DataFrame) -> DataFrame:
    """A distribution as one ``MAP<event, count>``; one entry per event id, so it stays small."""
    return distribution.agg(
        F.map_from_entries(F.collect_list(F.struct("event_id", "total_count"))).alias("event_distribution")
    )


def batch_list(stats: DataFrame, newest: int | None = 10) -> DataFrame:
    """Batches by id, newest first, with rows, blocks, time span and risk tier.

    The tier follows the number of (block, event) rows.
    """
    listed = stats.groupBy("batch_id").agg(
        F.count("*").alias("row_count"),
        F.count_distinct("block_id").alias("block_count"),
        F.min("last_updated").alias("first_seen"),
        F.max("last_updated").alias("last_seen"),
    )
    listed = listed.withColumn("batch_time", batch_time(F.col("batch_id"))).withColumn(
        "risk", batch_risk(F.col("row_count"))
    )
    ordered = listed.orderBy(F.desc("batch_id"))
    return ordered.limit(newest) if newest else ordered


def batch_totals(listed: DataFrame) -> DataFrame:
    """The closing line of a batch list."""
    return listed.agg(
        F.count("*").alias("batches"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("block_count"), F.lit(0)).alias("total_blocks"),
    )


def batch_report(stats: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Rows per batch next to its anomaly rows, 0 when it has none."""
    rows = stats.groupBy("batch_id").agg(
        F.count("*").alias("row_count"),
        F.min("last_updated").alias("first_seen"),
        F.max("last_updated").alias("last_seen"),
    )
    found = anomalies.groupBy("batch_id").agg(F.count("*").alias("anomaly_count"))
    return rows.join(found, "batch_id", "left").withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
