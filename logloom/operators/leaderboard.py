"""The table of the highest-scoring blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_EVENTS
from .anomalies import best_per_block, top_anomalies

DETAIL_SECONDS = 3600


def leaderboard(
    anomalies: DataFrame,
    n: int = 10,
    score_mode: str = "latest",
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> DataFrame:
    """The ``n`` blocks with the highest score, ties by falling block id.

    ``latest`` scores a block by its newest row, ``max`` by its best one; the
    event counts come from that same row.
    """
    if score_mode not in ("latest", "max"):
        raise ValueError(f"unknown score mode: {score_mode}")
    newest = [F.desc("detected_at"), F.desc("anomaly_score")]
    rows = best_per_block(anomalies, newest if score_mode == "latest" else newest[::-1])
    return top_board(
        rows.select("block_id", "anomaly_score", *event_ids, F.col("detected_at").alias("updated_at")), n
    )


def top_board(rows: DataFrame, n: int) -> DataFrame:
    """Rows of distinct blocks cut to a board, with the time their detail runs out."""
    timed = rows.withColumn("expires_at", F.timestamp_add("SECOND", F.lit(DETAIL_SECONDS), F.col("updated_at")))
    return timed.orderBy(F.desc("anomaly_score"), F.desc("block_id")).limit(n)


def expire_details(
    board: DataFrame, as_of: Column, drop: bool = False, event_ids: Sequence[str] = DEFAULT_EVENTS
) -> DataFrame:
    """Forget details past their time: empty the event columns, or drop the rows."""
    live = F.col("expires_at") > as_of
    if drop:
        return board.where(live)
    return board.withColumns({e: F.when(live, F.col(e)) for e in event_ids})


def read_anomalies(
    board: DataFrame | None,
    anomalies: DataFrame,
    limit: int,
    ranged: DataFrame | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> tuple[str, DataFrame]:
    """Where an answer comes from, and its rows (O3).

    The board serves an unlimited range when it holds anything; otherwise the
    table does (``ranged`` when a time range was asked for).
    """
    columns = ["block_id", "anomaly_score", *event_ids]
    if ranged is None and board is not None and not board.isEmpty():
        rows = board.orderBy(F.desc("anomaly_score"), F.desc("block_id")).limit(limit)
        return "leaderboard", rows.select(*columns, F.col("updated_at").alias("detected_at"))
    rows = top_anomalies(anomalies if ranged is None else ranged, limit)
    name = "none" if rows.isEmpty() else "table"
    return name, rows.select(*columns, "detected_at")
