"""Details of scored blocks that leave the state, and the board, when their time is over (ST5, N5)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.leaderboard import DETAIL_SECONDS
from ..schemas import DEFAULT_EVENTS, event_fields
from .board import clear_board, read_board, replace_board, update_board
from .jobs import start


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _micros(moment: datetime | None) -> int:
    if moment is None:
        raise ValueError("a row without detected_at has no end")
    return (moment.replace(tzinfo=moment.tzinfo or timezone.utc) - _EPOCH) // timedelta(microseconds=1)


class KeepDetails(StatefulProcessor):
    """The newest detail of a block, until its timer goes off; each change is handed on.

    There are many blocks with few rows each, so rows are taken as they come and
    not made into a table per block.
    """

    def __init__(self, columns: Sequence[str], kinds: str, seconds: int, wall_clock: bool) -> None:
        # The time is the last column and held in microseconds.
        self.columns, self.kinds = list(columns), kinds
        self.length, self.wall_clock = seconds * 1000, wall_clock
        self.out = Row("block_id", *columns, "live")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.detail = handle.getValueState("detail", f"{self.kinds}, moment long, ends long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = place = None
        for row in rows:
            # A row without a score counts as the highest of its time.
            score = row["anomaly_score"]
            at = (_micros(row["detected_at"]), float("inf") if score is None else score)
            if best is None or at >= place:
                best, place = row, at
        held = self.detail.get()
        values = [best[c] for c in self.columns]
        if held is not None:
            score = held[-3]
            if (held[-2], float("inf") if score is None else score) >= place:
                return  # an older row changes nothing
            self.handle.deleteTimer(held[-1])
        ends = self.length + (timerValues.getCurrentProcessingTimeInMs() if self.wall_clock else place[0] // 1000)
        self.detail.update((*values[:-1], place[0], ends))
        self.handle.registerTimer(ends)
        yield self.out(key[0], *values, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.detail.get()
        self.detail.clear()
        yield self.out(key[0], *held[:-2], _EPOCH + timedelta(microseconds=held[-2]), False)

    def close(self) -> None:
        pass


def live_details(
    anomalies: DataFrame,
    seconds: int = DETAIL_SECONDS,
    late: str | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> DataFrame:
    """Changes of the blocks' details: ``block_id, E.., anomaly_score, detected_at, live``.

    A block's newest row (ties: highest score) is its detail. ``live`` is false
    once ``seconds`` have passed since then and the detail has left the state;
    no row of the block, or of any other, is needed for that: by the wall clock
    Spark goes on with micro-batches that hold no rows. With ``late`` the time
    of the rows themselves counts instead, up to that much behind the newest.
    """
    columns = [*event_ids, "anomaly_score", "detected_at"]
    rows = anomalies.select("block_id", *columns)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    if late is not None:
        rows = rows.withWatermark("detected_at", late)
    held = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns[:-1])
    return rows.groupBy("block_id").transformWithState(
        KeepDetails(columns, held, seconds, late is None),
        outputStructType=f"block_id string, {kinds}, live boolean",
        outputMode="update",
        timeMode="processingTime" if late is None else "eventTime",
    )


def keep_board(
    anomalies: DataFrame,
    board_path: str,
    checkpoint: str,
    n: int = 10,
    drop: bool = False,
    seconds: int = DETAIL_SECONDS,
    late: str | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    every: str | None = None,
) -> StreamingQuery:
    """A stored board whose expired details are emptied, or whose expired blocks go (``drop``), within the stream."""
    spark = anomalies.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            update_board(spark, board_path, batch.where("live").drop("live"), 2 * number, n, event_ids)
            # A block that has expired and come again in one micro-batch is live.
            gone = batch.where("NOT live").select("block_id", F.col("detected_at").alias("_of")).distinct()
            board = read_board(spark, board_path, 2 * number + 1)
            if board is None:
                return
            ended = board.join(gone, "block_id", "left").withColumn("_ended", F.coalesce(F.col("_of") >= F.col("updated_at"), F.lit(False)))
            if drop:
                kept = ended.where("NOT _ended")
            else:
                kept = ended.withColumns({e: F.when(~F.col("_ended"), F.col(e)) for e in event_ids})
            kept = kept.select(*board.columns)
            if kept.isEmpty():
                clear_board(spark, board_path, confirm=True)
            else:
                replace_board(spark, board_path, kept, 2 * number + 1)
        finally:
            batch.unpersist()

    writer = live_details(anomalies, seconds, late, event_ids).writeStream.outputMode("update").foreachBatch(handle)
    return start(spark, writer, checkpoint, every)
