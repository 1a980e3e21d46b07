"""Batch and incremental scoring jobs, batch reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import batch_list
from ..operators.anomalies import above, best_per_block, top_events
from ..operators.batches import incremental_features, pending_batches
from ..operators.features import pivot_counts
from ..operators.leaderboard import leaderboard, top_board
from ..schemas import DEFAULT_EVENTS
from ..session import written_once
from ..sizing import lookup, rows_if_small
from ..sources.sinks import append_anomalies
from ..streaming.board import read_board, update_board

Scorer = Callable[[DataFrame], DataFrame]

MAX_LISTED = 10_000

LEDGER = T.StructType([T.StructField("batch_id", T.StringType())])
MARK = T.StructType([T.StructField("mark", T.TimestampNTZType())])


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def of_batches(stats: DataFrame, batches: DataFrame, limit: int = MAX_LISTED) -> DataFrame:
    """Rows of the given batches.

    A short list becomes a literal filter, which prunes partitions of a table
    stored by batch; a longer one is a semi join.
    """
    ids = rows_if_small(batches.select("batch_id"), limit)
    if ids is None:
        return stats.join(batches, "batch_id", "left_semi")
    return stats.where(F.col("batch_id").isin([r.batch_id for r in ids]))


def score_batches(
    stats: DataFrame,
    batches: DataFrame,
    scorer: Scorer,
    threshold: float = 0.5,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> DataFrame:
    """Anomaly rows of the given batches, all in one job."""
    wide = pivot_counts(
        of_batches(stats, batches),
        event_ids,
        ("batch_id", "block_id"),
        [F.max("last_updated").alias("detected_at")],
    )
    return above(scorer(wide), threshold).select(
        "batch_id", "block_id", *event_ids, "anomaly_score", "detected_at"
    )


def process_offline_batches(
    stats: DataFrame,
    anomalies_path: str,
    ledger_path: str,
    scorer: Scorer,
    threshold: float = 0.5,
    batch_id: str | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> DataFrame:
    """Score pending batches or one named batch, store the anomalies, note the batches as done.

    A batch without anomalies is noted too. A failure before the note leaves the
    batch pending, and scoring it again replaces its rows.
    """
    spark = stats.sparkSession
    if batch_id is not None:
        batches = stats.where(F.col("batch_id") == batch_id).select("batch_id").distinct()
    else:
        batches = pending_batches(stats, stored(spark, ledger_path, LEDGER))
    # The list is written down first: batches arriving meanwhile must stay pending.
    batches = written_once(batches, "pending")
    append_anomalies(score_batches(stats, batches, scorer, threshold, event_ids), anomalies_path, batches)
    batches.write.mode("append").parquet(ledger_path)
    return batches


def score_incremental(
    stats: DataFrame,
    scorer: Scorer,
    mark: Column,
    threshold: float = 0.5,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> DataFrame:
    """Anomaly rows of the blocks touched after the mark, from their full history."""
    wide = incremental_features(stats, mark, event_ids).withColumnRenamed("last_updated", "detected_at")
    return above(scorer(wide), threshold)


def run_incremental(
    stats: DataFrame,
    anomalies_path: str,
    board_path: str,
    mark_path: str,
    scorer: Scorer,
    start: datetime,
    threshold: float = 0.5,
    top_n: int = 10,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> datetime | None:
    """One round: score, append, refresh the board, move the mark. Returns the new mark.

    The round covers rows up to the new mark only, and its rows are stored under
    that mark, so repeating a failed round replaces what it had written.
    """
    spark = stats.sparkSession
    last = stored(spark, mark_path, MARK).agg(F.max("mark")).first()[0] or start
    upper = stats.where(F.col("last_updated") > F.lit(last)).agg(F.max("last_updated")).first()[0]
    if upper is None:
        return None
    run = int((upper - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    snapshot = stats.where(F.col("last_updated") <= F.lit(upper))
    found = score_incremental(snapshot, scorer, F.lit(last), threshold, event_ids)
    append_anomalies(found.withColumn("batch_id", F.lit(f"online_{run}")), anomalies_path)
    fresh = spark.read.parquet(anomalies_path).where(F.col("batch_id") == f"online_{run}")
    update_board(spark, board_path, fresh, run, top_n, event_ids)
    spark.createDataFrame([(upper,)], MARK).write.mode("append").parquet(mark_path)
    return upper


def sync_leaderboard(
    anomalies: DataFrame,
    mark: Column | None = None,
    n: int = 10,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    board: DataFrame | None = None,
) -> DataFrame:
    """Best scores of the blocks with a row after the mark, put onto the stored board.

    Each block keeps the counts of the row its best score came from. Blocks of
    ``board`` that were not touched stay as they are and compete for its places.
    """
    rows = anomalies
    if mark is not None:
        touched = anomalies.where(F.col("detected_at") > mark).select("block_id").distinct()
        rows = anomalies.join(touched, "block_id", "left_semi")
    fresh = leaderboard(rows, n, "max", event_ids)
    if board is None:
        return fresh
    columns = ["block_id", "anomaly_score", *event_ids, "updated_at"]
    stays = board.join(rows.select("block_id").distinct(), "block_id", "left_anti").select(*columns)
    return top_board(fresh.select(*columns).union(stays), n)


def list_batches(stats: DataFrame, newest: int | None = 10) -> DataFrame:
    return batch_list(stats, newest)


def batch_anomalies(
    anomalies: DataFrame,
    batch_id: str | None,
    meanings: DataFrame,
    n: int = 5,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> DataFrame:
    """Best row per block of a batch with its most frequent events, meanings and bars.

    Without a batch id all batches are reported at once.
    """
    rows = anomalies if batch_id is None else anomalies.where(F.col("batch_id") == batch_id)
    best = best_per_block(rows).select("block_id", "anomaly_score", *event_ids)
    return lookup(top_events(best, event_ids, n), meanings, "event_id", "meaning", "meaning", "Unknown")


__all__ = [
    "batch_anomalies", "list_batches", "process_offline_batches", "read_board", "run_incremental",
    "score_batches", "score_incremental", "sync_leaderboard",
]
