"""A small stored leaderboard, replaced per run or micro-batch (O2, ST5, N3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.anomalies import best_per_block
from ..operators.leaderboard import top_board
from ..schemas import DEFAULT_EVENTS

SLOTS = 8


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # Nothing was written yet, or only folders without rows.
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _slots(rows: DataFrame | None, before: int | None = None) -> dict[int, int]:
    """Stored versions and their slots, at most ``SLOTS`` of them."""
    if rows is None:
        return {}
    held = {r.version: r.slot for r in rows.select("version", "slot").distinct().collect()}
    return held if before is None else {v: s for v, s in held.items() if v < before}


def read_board(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the board (or the newest one before ``before``); None without any.

    Only the slot of that version is read.
    """
    rows = _stored(spark, path)
    held = _slots(rows, before)
    if not held:
        return None
    return rows.where(F.col("slot") == held[max(held)]).drop("version", "slot")


def update_board(
    spark: SparkSession,
    path: str,
    anomalies: DataFrame,
    version: int,
    n: int = 10,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> None:
    """Put new scores on the board: newest score per block, the ``n`` highest stay.

    A version starts from the one before it and goes to its own slot, so
    repeating a run gives the same board. A handful of slots is used in turn.
    A version without any row leaves the board as it is.
    """
    newest = [F.desc("detected_at"), F.desc("anomaly_score")]
    fresh = best_per_block(anomalies, newest).select(
        "block_id", "anomaly_score", *event_ids, F.col("detected_at").alias("updated_at")
    )
    current = read_board(spark, path, version)
    if current is not None:
        old = current.select(*fresh.columns).withColumn("_new", F.lit(0))
        rank = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("_new")))
        both = old.unionByName(fresh.withColumn("_new", F.lit(1))).withColumn("_rank", rank)
        fresh = both.where(F.col("_rank") == 1).drop("_rank", "_new")
    replace_board(spark, path, top_board(fresh, n), version)


def replace_board(spark: SparkSession, path: str, board: DataFrame, version: int) -> None:
    """Store a board of few rows as a version of its own, in the slot after the version before it."""
    board = board.withColumn("version", F.lit(version).cast("bigint"))
    held = _slots(_stored(spark, path))
    older = [v for v in held if v < version]
    slot = held.get(version, (held[max(older)] + 1) % SLOTS if older else 0)
    # At most n rows, so one small file.
    board.coalesce(1).write.mode("overwrite").parquet(f"{path}/slot={slot}")


def clear_board(spark: SparkSession, path: str, mark_path: str | None = None, confirm: bool = False) -> None:
    """Forget the board with its details, and the mark up to which scores were taken."""
    if not confirm:
        raise ValueError("clearing the leaderboard needs confirm=True")
    rows = _stored(spark, path)
    if rows is not None:
        spark.createDataFrame([], rows.schema).write.mode("overwrite").partitionBy("slot").parquet(path)
    marks = _stored(spark, mark_path) if mark_path else None
    if marks is not None:
        spark.createDataFrame([], marks.schema).write.mode("overwrite").parquet(mark_path)
