"""Ordered threshold and priority rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Events whose lines count as anomalous, and the order in which a
# block's events decide its anomaly type.
ANOMALY_EVENTS = [
    "E1", "E4", "E7", "E8", "E10", "E12", "E13", "E14", "E17",
    "E20", "E23", "E24", "E27", "E28", "E29",
]
TYPE_PRIORITY = ["E7", "E21", "E5", "E4"]


def is_anomaly_event(event: Column) -> Column:
    return event.isin(ANOMALY_EVENTS)


def anomaly_type(event_ids: Sequence[str]) -> Column:
    """Number of the most important event the block has, 0 when it has none of them."""
    out = F.lit(0)
    for event in reversed(TYPE_PRIORITY):
        if event in event_ids:
            out = F.when(F.col(event) > 0, F.lit(int(event[1:]))).otherwise(out)
    return out


def tier(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step the value lies above."""
    out = F.lit(otherwise)
    for bound, name in reversed(list(steps)):
        out = F.when(value > bound, F.lit(name)).otherwise(out)
    return out


def severity(score: Column) -> Column:
    return tier(score, [(0.8, "high"), (0.5, "medium")], "low")


def report_tier(score: Column) -> Column:
    """Which report a block gets: a score on a bound belongs to the tier above it."""
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def anomaly_flag(score: Column) -> Column:
    return tier(score, [(0.5, "anomaly")], "normal")


def batch_risk(rows: Column) -> Column:
    return tier(rows, [(50, "high"), (20, "medium")], "normal")


def health_percent(anomalies: Column, total: Column) -> Column:
    """Share of healthy blocks in percent; an empty system is healthy."""
    return F.when(total > 0, F.round((1 - anomalies / total) * 100, 1)).otherwise(F.lit(100.0))


def health_tier(percent: Column) -> Column:
    return F.when(percent < 80, "attention").when(percent < 95, "good").otherwise("excellent")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole``, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def label_target(label: Column) -> Column:
    """Success -> 0, Fail -> 1, anything else -> null."""
    return F.when(label == "Success", 0).when(label == "Fail", 1).cast("int")


def target_label(target: Column) -> Column:
    return F.when(target == 1, "Fail").otherwise("Success")


def batch_time(batch: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Epoch-second batch id as a time text, ``unknown`` for any other id."""
    seconds = batch.try_cast("bigint")
    moment = F.timestamp_add("SECOND", seconds, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.coalesce(F.date_format(moment, pattern), F.lit("unknown"))
