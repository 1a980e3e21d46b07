"""Selections over anomaly rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext as sq
from ..functions.tiers import severity
from ..schemas import DEFAULT_EVENTS
from .features import event_array, unpivot_counts


def above(df: DataFrame, threshold: float, score: str = "anomaly_score") -> DataFrame:
    return df.where(F.col(score) > threshold)


def range_seconds(
    seconds: int | None = None,
    minutes: int | None = None,
    hours: int | None = None,
    days: int | None = None,
) -> int:
    """Length of a relative range; the finest unit given wins, one hour when none is."""
    for amount, size in ((seconds, 1), (minutes, 60), (hours, 3600), (days, 86400)):
        if amount is not None:
            return amount * size
    return 3600


def since(df: DataFrame, time: str, as_of: Column | datetime | None, length: int) -> DataFrame:
    """Rows of the last ``length`` seconds before ``as_of`` (default: now)."""
    moment = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    wall_clock = df.schema[time].dataType.typeName() == "timestamp_ntz"
    moment = moment.cast("timestamp_ntz" if wall_clock else "timestamp")
    return df.where(F.col(time) >= F.timestamp_add("SECOND", F.lit(-length), moment))


def latest(df: DataFrame, time: str) -> Column:
    """The newest time in ``df`` as a scalar subquery, to anchor ranges without an extra job."""
    return df.select(F.max(time).alias("latest")).scalar()


def top_anomalies(df: DataFrame, limit: int) -> DataFrame:
    """Highest scores first; equal scores by block, then newest."""
    return df.orderBy(F.desc("anomaly_score"), "block_id", F.desc("detected_at")).limit(limit)


def best_per_block(df: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """The highest-scoring row of every block.

    The rank filter is applied on both sides of the shuffle, so a block with
    many duplicate rows sends one row per input partition.
    """
    by = order or [F.desc("anomaly_score"), F.desc("detected_at"), F.desc("batch_id")]
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(*by))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def with_events(df: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS, by_count: bool = False) -> DataFrame:
    """Replace the event columns by one array of the events that occurred."""
    return df.withColumn("events", event_array(event_ids, by_count)).drop(*event_ids)


def top_events(
    df: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS, n: int = 5, width: int = 10
) -> DataFrame:
    """The ``n`` most frequent events of each row with a bar length.

    The counts of a row sit in its columns, so no window and no shuffle is needed.
    """
    largest = F.expr(f"greatest({', '.join(map(sq.name, event_ids))}, 0)")
    keep = [c for c in df.columns if c not in event_ids]
    shaped = df.select(
        *keep,
        largest.alias("_largest"),
        F.posexplode(F.slice(event_array(event_ids, by_count=True), 1, n)).alias("_pos", "_event"),
    )
    count = F.col("_event.count")
    return shaped.select(
        *keep,
        (F.col("_pos") + 1).alias("event_rank"),
        F.col("_event.event_id").alias("event_id"),
        count.alias("cnt"),
        F.floor(count * width / F.col("_largest")).cast("int").alias("bar"),
    )


def listed_event_totals(listed: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS, n: int = 8) -> DataFrame:
    """Most frequent events over a list of anomalies."""
    return (
        unpivot_counts(listed.select(*event_ids), event_ids)
        .groupBy("event_id")
        .agg(F.sum("cnt").alias("total_count"))
        .orderBy(F.desc("total_count"), F.expr("cast(substr(event_id, 2) as int)"))
        .limit(n)
    )


def with_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", severity(F.col("anomaly_score")))
