"""Explicit schemas. The event list is a parameter everywhere; E1..E29 is the default."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

DEFAULT_EVENTS: list[str] = [f"E{i}" for i in range(1, 30)]

TEMPLATES = T.StructType(
    [T.StructField("EventId", T.StringType()), T.StructField("EventTemplate", T.StringType())]
)

LABELS = T.StructType(
    [T.StructField("block_id", T.StringType()), T.StructField("label", T.StringType())]
)

STATS = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("cnt", T.LongType()),
        T.StructField("last_updated", T.TimestampNTZType()),
    ]
)


def event_order(event_ids: Iterable[str]) -> list[str]:
    """Event ids by their number: E2 before E10."""
    return sorted(event_ids, key=lambda e: int(e[1:]))


def event_fields(event_ids: Sequence[str] = DEFAULT_EVENTS) -> list[T.StructField]:
    return [T.StructField(e, T.LongType()) for e in event_ids]


def wide_record(event_ids: Sequence[str] = DEFAULT_EVENTS) -> T.StructType:
    """One uploaded block with its counts, as carried in a JSON message."""
    return T.StructType(
        [
            T.StructField("batch_id", T.StringType()),
            T.StructField("block_id", T.StringType()),
            *event_fields(event_ids),
        ]
    )


def anomaly_rows(event_ids: Sequence[str] = DEFAULT_EVENTS) -> T.StructType:
    return T.StructType(
        [
            T.StructField("batch_id", T.StringType()),
            T.StructField("block_id", T.StringType()),
            *event_fields(event_ids),
            T.StructField("anomaly_score", T.DoubleType()),
            T.StructField("detected_at", T.TimestampNTZType()),
        ]
    )
