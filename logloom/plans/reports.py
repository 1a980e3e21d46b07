"""Anomaly queries (F6-F11, F15, F17). Every answer is a DataFrame; nested parts stay columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiers
from ..operators import aggregates, anomalies as an
from ..operators.features import event_array
from ..operators.leaderboard import read_anomalies
from ..schemas import DEFAULT_EVENTS
from ..sources.sinks import export_rows

LISTED = 100


@dataclass(frozen=True)
class Report:
    """Parts of one answer."""

    summary: DataFrame
    rows: DataFrame
    distribution: DataFrame
    source: str = "table"


def analysis_summary(stats: DataFrame, anomalies: DataFrame, as_of: Column | None = None, length: int = 3600) -> DataFrame:
    """Blocks in total, blocks anomalous in the range, their ratio.

    ``anomaly_count`` counts distinct blocks without a cap; ``listed_count`` is
    the length of the list a reader sees, at most 100 rows, and
    ``listed_ratio`` the ratio made from it.
    """
    recent = an.since(anomalies, "detected_at", as_of, length)
    found = recent.agg(F.count("*").alias("hits"), F.count_distinct("block_id").alias("anomaly_count"))
    out = found.select(
        aggregates.total_blocks(stats).scalar().alias("total_blocks"),
        "anomaly_count",
        F.least("hits", F.lit(LISTED)).alias("listed_count"),
    )
    total = F.col("total_blocks")
    return out.withColumns(
        {
            "anomaly_ratio": tiers.ratio(F.col("anomaly_count"), total),
            "listed_ratio": tiers.ratio(F.col("listed_count"), total),
        }
    )


def analyze(
    stats: DataFrame,
    anomalies: DataFrame,
    as_of: Column | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> Report:
    """Summary, the ten worst blocks of the last hour with their events, all-time distribution."""
    worst = an.top_anomalies(an.since(anomalies, "detected_at", as_of, 3600), 10)
    rows = worst.select(
        "block_id",
        F.col("anomaly_score").alias("probability"),
        tiers.anomaly_flag(F.col("anomaly_score")).alias("label"),
        event_array(event_ids, by_count=True).alias("events"),
    )
    return Report(analysis_summary(stats, anomalies, as_of), rows, aggregates.event_distribution(stats))


def recent_anomalies(
    anomalies: DataFrame,
    hours: int = 1,
    limit: int = LISTED,
    as_of: Column | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> DataFrame:
    rows = an.top_anomalies(an.since(anomalies, "detected_at", as_of, hours * 3600), limit)
    return rows.select("block_id", "anomaly_score", "detected_at", event_array(event_ids).alias("events"))


def query_anomalies(
    stats: DataFrame,
    anomalies: DataFrame,
    limit: int = LISTED,
    seconds: int | None = None,
    minutes: int | None = None,
    hours: int | None = None,
    days: int | None = None,
    as_of: Column | None = None,
    legacy_window: bool = False,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> Report:
    """Anomalies of a flexible range with the event distribution of the same range.

    ``legacy_window`` always takes the distribution over one hour.
    """
    length = an.range_seconds(seconds, minutes, hours, days)
    ranged = an.since(anomalies, "detected_at", as_of, length)
    rows = an.top_anomalies(ranged, limit).select(
        "block_id", "anomaly_score", "detected_at", event_array(event_ids).alias("events")
    )
    span = 3600 if legacy_window else length
    distribution = aggregates.event_distribution(an.since(stats, "last_updated", as_of, span))
    summary = ranged.agg(F.least(F.count("*"), F.lit(limit)).alias("anomaly_count"))
    return Report(summary, rows, distribution)


def realtime_anomalies(
    stats: DataFrame,
    anomalies: DataFrame,
    board: DataFrame | None = None,
    limit: int = 10,
    hours: int | None = None,
    as_of: Column | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> Report:
    """The board when no range is asked for and it holds rows, else the table."""
    ranged = an.since(anomalies, "detected_at", as_of, hours * 3600) if hours else None
    source, rows = read_anomalies(board, anomalies, limit, ranged, event_ids)
    spread = an.since(stats, "last_updated", as_of, hours * 3600) if hours else stats
    summary = rows.agg(F.count("*").alias("anomaly_count")).withColumn("source", F.lit(source))
    return Report(
        summary, rows.withColumn("source", F.lit(source)), aggregates.event_distribution(spread), source
    )


def export_anomalies(
    anomalies: DataFrame, board: DataFrame | None = None, event_ids: Sequence[str] = DEFAULT_EVENTS
) -> DataFrame:
    """Flat rows for a download: the ten board rows, else the hundred worst of the table."""
    if board is not None and not board.isEmpty():
        rows = board.orderBy(F.desc("anomaly_score"), F.desc("block_id")).limit(10)
        dated = rows.select("block_id", "anomaly_score", F.col("updated_at").alias("detected_at"), *event_ids)
        return export_rows(dated, event_ids)
    rows = an.top_anomalies(anomalies, LISTED).select("block_id", "anomaly_score", "detected_at", *event_ids)
    return export_rows(rows, event_ids)


def system_health(stats: DataFrame, anomalies: DataFrame, as_of: Column | None = None, length: int = 3600) -> DataFrame:
    """Total blocks, anomalous blocks of the range, health in percent and its tier."""
    summary = analysis_summary(stats, anomalies, as_of, length)
    percent = tiers.health_percent(F.col("anomaly_count"), F.col("total_blocks"))
    return summary.select("total_blocks", "anomaly_count", percent.alias("health_percent")).withColumn(
        "status", tiers.health_tier(F.col("health_percent"))
    )


def dashboard(
    stats: DataFrame,
    anomalies: DataFrame,
    board: DataFrame | None = None,
    limit: int = 10,
    hours: int | None = 1,
    as_of: Column | None = None,
    shown: int = 6,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> Report:
    """Top rows with their first events and a count of the rest, their event totals, health.

    A row whose event detail has expired shows the most common events instead.
    """
    report = realtime_anomalies(stats, anomalies, board, limit, hours, as_of, event_ids)
    entry = F.struct((-F.col("total_count")).alias("k"), "event_id", F.col("total_count").alias("count"))
    common = report.distribution.limit(shown).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    plain = F.transform("e", lambda x: F.struct(x["event_id"].alias("event_id"), x["count"].alias("count")))
    order = common.select(plain).scalar()
    own = event_array(event_ids)
    missing = F.col(event_ids[0]).isNull()
    listed = report.rows.withColumn("_events", F.when(missing, order).otherwise(own))
    rows = listed.select(
        "block_id",
        F.col("anomaly_score").alias("probability"),
        tiers.severity(F.col("anomaly_score")).alias("severity"),
        F.slice("_events", 1, shown).alias("events"),
        F.greatest(F.size("_events") - shown, F.lit(0)).alias("more"),
        "source",
    )
    totals = (
        listed.select(F.inline("_events"))
        .groupBy("event_id")
        .agg(F.sum("count").alias("total_count"))
        .orderBy(F.desc("total_count"), "event_id")
    )
    summary = listed.agg(F.count("*").alias("anomaly_count")).select(
        aggregates.total_blocks(stats).scalar().alias("total_blocks"), "anomaly_count"
    )
    summary = summary.withColumn(
        "health_percent", tiers.health_percent(F.col("anomaly_count"), F.col("total_blocks"))
    )
    return Report(summary, rows, totals, report.source)
