"""Event sequences, masked templates and count windows (F21, X24, ST6 in batch)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.once import computed_once
from ..functions.patterns import Template, all_matches, first_match
from ..schemas import event_order
from ..session import written_once
from .ordering import rank_in_time


def block_traces(
    lines: DataFrame, templates: Sequence[Template], time: str = "ts", tie: str = "line_no"
) -> DataFrame:
    """Events of every block in time order: ``block_id, position, event_id, time``.

    One row per event instead of one array per block, so a block may have any
    number of events. The lines are parsed once, into a narrow table.
    """
    text = F.col("line")
    parsed = computed_once(lines, [time, tie], block_id=tx.block_id(text), events=all_matches(text, templates))
    events = parsed.where(F.col("block_id").isNotNull()).select(
        "block_id", time, tie, F.explode("events").alias("event_id")
    )
    return rank_in_time(written_once(events, "traces"), time, [tie, "event_id"], "block_id")


def masked_templates(lines: DataFrame, line: str = "line") -> DataFrame:
    """Distinct line shapes with their frequency."""
    return lines.groupBy(tx.mask_variables(F.col(line)).alias("template")).agg(F.count("*").alias("lines"))


def time_windows(
    lines: DataFrame, templates: Sequence[Template], time: str = "ts", length: str = "1 minute"
) -> DataFrame:
    """Template counts per tumbling window, one wide row per window with any match."""
    ids = event_order(dict(templates))
    matched = computed_once(lines, [time], event_id=first_match(F.col("line"), templates)).where(
        F.col("event_id").isNotNull()
    )
    return (
        matched.groupBy(F.window(time, length).alias("w"))
        .agg(*[F.count_if(F.col("event_id") == e).alias(e) for e in ids])
        .select(F.col("w.start").alias("window_start"), *ids)
    )


def row_windows(
    lines: DataFrame, templates: Sequence[Template], size: int, time: str = "ts", tie: str = "line_no"
) -> DataFrame:
    """Template counts per run of ``size`` consecutive lines."""
    ids = event_order(dict(templates))
    parsed = lines.select(time, tie, first_match(F.col("line"), templates).alias("event_id"))
    numbered = rank_in_time(written_once(parsed, "rows"), time, [tie])
    matched = numbered.withColumn("window_no", F.floor((F.col("position") - 1) / size))
    return matched.groupBy("window_no").agg(
        F.count("*").alias("lines"), *[F.count_if(F.col("event_id") == e).alias(e) for e in ids]
    )
