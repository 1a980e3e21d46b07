"""Template counts per run of N consecutive lines, on a stream (ST6)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.patterns import Template, first_match
from ..operators.ordering import rank_in_time
from ..schemas import event_order
from .jobs import start

_ROW = "ts timestamp, tie long, event_id string"
_BLOCK = pa.schema([("ts", pa.timestamp("us")), ("tie", pa.int64()), ("event_id", pa.string())])
#: Rows in one value of the state.
BLOCK_ROWS = 2_000
#: Stored totals; a repeated micro-batch finds that of the one before it.
TOTALS = 8


class HoldRows(StatefulProcessor):
    """Keeps the rows of a time slot until the watermark has passed its end, then hands them out once.

    Rows go to the state and come back in Arrow blocks, not one by one, and no
    more than a block of them is held here.
    """

    def __init__(self, slot_ms: int) -> None:
        self.slot_ms, self.block_rows = slot_ms, BLOCK_ROWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.blocks.exists()
        for part in rows:
            table = pa.Table.from_pandas(part[_BLOCK.names], _BLOCK, preserve_index=False).replace_schema_metadata()
            blocks = [(b.serialize().to_pybytes(),) for b in table.to_batches(self.block_rows)]
            if blocks:
                self.blocks.appendList(blocks)
        if not known:
            # Every line of the slot is older than this moment.
            self.handle.registerTimer((key[0] + 1) * self.slot_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for (block,) in self.blocks.get():
            held = pa.ipc.read_record_batch(pa.py_buffer(block), _BLOCK)
            yield held.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        self.blocks.clear()

    def close(self) -> None:
        pass


def settled_rows(
    lines: DataFrame,
    templates: Sequence[Template],
    late: str,
    time: str = "ts",
    tie: str = "line_no",
    slot_seconds: int = 60,
    salts: int = 8,
) -> DataFrame:
    """``ts, tie, event_id`` of every line, each once its slot of time can get no more lines.

    State is kept by slot and salt, so that the lines of a busy slot lie on
    several tasks; it holds what is newer than the watermark and nothing else.
    """
    parsed = lines.withWatermark(time, late).select(
        F.floor(F.unix_millis(time) / (slot_seconds * 1000)).cast("long").alias("slot"),
        F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int").alias("salt"),
        F.col(time).alias("ts"),
        F.col(tie).cast("long").alias("tie"),
        first_match(F.col("line"), templates).alias("event_id"),
    )
    return parsed.groupBy("slot", "salt").transformWithStateInPandas(
        HoldRows(slot_seconds * 1000), outputStructType=_ROW, outputMode="append", timeMode="eventTime"
    )


def write_row_windows(
    lines: DataFrame,
    templates: Sequence[Template],
    size: int,
    path: str,
    checkpoint: str,
    late: str,
    time: str = "ts",
    tie: str = "line_no",
    slot_seconds: int = 60,
    every: str | None = None,
) -> StreamingQuery:
    """Count templates per run of ``size`` lines in time order, however the lines arrive.

    Lines up to ``late`` older than the newest are put in their place; later
    ones are dropped. Each micro-batch numbers the lines that have settled,
    after those of the micro-batches before it, and stores its share of every
    window under its own number; so a repeated micro-batch replaces itself. The
    open window lives in those shares and in the stored number of lines.
    """
    spark = lines.sparkSession
    ids = event_order(dict(templates))

    def store(batch: DataFrame, number: int) -> None:
        # Kept, since every action would go through the state again.
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                number_lines(batch, number)
        finally:
            batch.unpersist()

    def number_lines(batch: DataFrame, number: int) -> None:
        before = _lines_before(spark, path, number)
        placed = rank_in_time(batch, "ts", ["tie"])
        shares = placed.withColumn("window_no", F.expr(f"({before} + position - 1) DIV {size}")).groupBy("window_no").agg(
            F.count("*").alias("lines"), *[F.count_if(F.col("event_id") == e).alias(e) for e in ids]
        )
        target = f"{path}/windows/micro_batch={number}"
        shares.write.mode("overwrite").parquet(target)
        done = spark.read.parquet(target).agg((F.lit(before) + F.sum("lines")).alias("lines"))
        done.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/totals/slot={number % TOTALS}")

    writer = settled_rows(lines, templates, late, time, tie, slot_seconds).writeStream.outputMode("append").foreachBatch(store)
    return start(spark, writer, checkpoint, every)


def _lines_before(spark: SparkSession, path: str, number: int) -> int:
    """Lines numbered by the micro-batches before this one."""
    try:
        totals = spark.read.parquet(f"{path}/totals")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return totals.where(F.col("version") < number).agg(F.max("lines")).first()[0] or 0


def read_row_windows(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """``window_no, lines, E..``: the stored windows; only complete ones when ``size`` is given."""
    shares = spark.read.parquet(f"{path}/windows")
    counted = [c for c in shares.columns if c not in ("window_no", "micro_batch")]
    whole = shares.groupBy("window_no").agg(*[F.sum(c).alias(c) for c in counted])
    return whole if size is None else whole.where(F.col("lines") == size)
