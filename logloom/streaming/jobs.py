"""Ingest, classification, running counts, scoring and windows on streams (ST1-ST9, S8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import text as tx
from ..functions.once import computed_once
from ..functions.patterns import Template, first_match
from ..operators.anomalies import above, best_per_block
from ..operators.classify import classify_lines
from ..operators.features import pivot_counts
from ..schemas import DEFAULT_EVENTS, event_order
from ..sources.logs import as_lines
from .board import update_board

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, off the JVM heap."""
    before = spark.conf.get(STORE_KEY, None)
    spark.conf.set(STORE_KEY, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE_KEY, before) if before else spark.conf.unset(STORE_KEY)


def read_log_drop(
    spark: SparkSession,
    path: str,
    archive: str | None = None,
    max_files: int = 100,
    pattern: str = "*.{log,txt}",
) -> DataFrame:
    """Lines of files dropped into a folder, each file once (S8, ST1).

    ``batch_id, line``; a file's batch is ``online_`` and its modification time,
    so a repeated micro-batch names it the same. ``max_files`` per trigger is
    the admission limit; finished files go to ``archive`` one trigger later.
    """
    reader = spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    raw = reader.text(path)
    stamp = F.unix_seconds(F.col("_metadata.file_modification_time")).cast("string")
    return as_lines(raw.select("value", F.concat(F.lit("online_"), stamp).alias("batch_id")))


def start(
    spark: SparkSession,
    writer,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Start a writer: at an interval, or through all that is there now and stop."""
    timed = writer.option("checkpointLocation", checkpoint)
    timed = timed.trigger(processingTime=every) if every else timed.trigger(availableNow=True)
    with disk_state(spark):
        return timed.start()


def counted(classified: DataFrame, name: str = "counters") -> DataFrame:
    """Attach the running counters of a classified stream to its progress reports."""
    kind, group = F.col("match_type"), F.col("type")
    return classified.observe(
        name,
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == "template").alias("template"),
        F.count_if(kind == "keyword_fallback").alias("keyword_fallback"),
        F.count_if(group == "anomaly").alias("anomaly"),
        F.count_if(group == "normal").alias("normal"),
        F.count_if(group == "unknown").alias("unknown"),
    )


def classify_stream(
    lines: DataFrame,
    templates: Sequence[Template],
    path: str,
    checkpoint: str,
    keyword_fallback: bool = True,
    every: str | None = None,
) -> StreamingQuery:
    """Classify a stream into a table with one folder per match type (ST2, K6).

    One pass writes both the explained lines and the unexplained ones; the
    folders other than ``template`` are the list for inspection. The file sink
    is exactly-once.
    """
    classified = counted(classify_lines(lines, templates, keyword_fallback))
    writer = (
        classified.writeStream.format("parquet").option("path", path).partitionBy("match_type").outputMode("append")
    )
    return start(lines.sparkSession, writer, checkpoint, every)


def matched_events(lines: DataFrame, templates: Sequence[Template], time: str = "ts") -> DataFrame:
    """``block_id, event_id, cnt, <time>`` of the lines that name a block and match a template."""
    text = F.col("line")
    parsed = computed_once(lines, [time], block_id=tx.block_id(text), event_id=first_match(text, templates))
    named = parsed.where(F.col("block_id").isNotNull() & F.col("event_id").isNotNull())
    return named.select("block_id", "event_id", F.lit(1).cast("bigint").alias("cnt"), time)


def running_counts(
    events: DataFrame,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    time: str = "ts",
    bucket: str | None = None,
    late: str | None = None,
) -> DataFrame:
    """Counts per block since the stream began (ST3), for the update mode.

    State is one row per block and is never dropped, as full-history features
    need. With ``bucket`` (for example ``1 day``) it is one row per block and
    bucket; the full history is then the sum over the stored buckets. No row is
    too late unless ``late`` is given: buckets that much older than the newest
    row leave the state, and what still comes for them is dropped.
    """
    newest = [F.max(time).alias("last_updated")]
    if bucket is None:
        return pivot_counts(events, event_ids, extra=newest)
    timed = (events.withWatermark(time, late) if late else events).withColumn("bucket", F.window(time, bucket))
    return pivot_counts(timed, event_ids, ("block_id", "bucket"), newest)


def write_updates(
    counts: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Store the changed rows of each micro-batch under its number, replacing a repeated one."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/micro_batch={number}")

    writer = counts.writeStream.outputMode("update").foreachBatch(store)
    return start(counts.sparkSession, writer, checkpoint, every)


def latest_counts(spark: SparkSession, path: str, event_ids: Sequence[str] = DEFAULT_EVENTS) -> DataFrame:
    """The newest stored counts per block; with buckets, their sum."""
    rows = spark.read.parquet(path)
    if "bucket" not in rows.columns:
        return best_per_block(rows, [F.desc("micro_batch")]).drop("micro_batch")
    keys = ["block_id", "bucket"]
    # Counts only grow, so the largest value of a bucket is its newest.
    per_bucket = rows.groupBy(*keys).agg(
        *[F.max(e).alias(e) for e in event_ids], F.max("last_updated").alias("last_updated")
    )
    return per_bucket.groupBy("block_id").agg(
        *[F.sum(e).alias(e) for e in event_ids], F.max("last_updated").alias("last_updated")
    )


def keep_counts(counts: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run the counts of ``running_counts`` for their state alone, which ``state_counts`` reads; nothing else is written."""
    return start(counts.sparkSession, counts.writeStream.format("noop").outputMode("update"), checkpoint, every)


def state_counts(
    spark: SparkSession, checkpoint: str, counts: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS
) -> DataFrame:
    """The newest counts per block, read from the state of the stream that keeps ``counts`` (ST3).

    The state has one row per block (and bucket), so reading costs as much as
    there are blocks, however long the stream has run and however many
    micro-batches it has had. The stream may go on meanwhile. ``counts`` is the
    DataFrame that was started, for the names of its columns.
    """
    with disk_state(spark):
        state = spark.read.format("statestore").load(checkpoint)
    # The values bear the names of the functions, several of them alike, and lie in the order of the columns.
    keys, held = len(state.schema["key"].dataType), state.schema["value"].dataType
    named = T.StructType([T.StructField(c, f.dataType) for c, f in zip(counts.columns[keys:], held)])
    flat = state.select("key.*", F.col("value").cast(named).alias("value")).select(*counts.columns[:keys], "value.*")
    sums = [F.coalesce(F.sum(e), F.lit(0)).alias(e) for e in event_ids]
    if "bucket" in counts.columns:
        return flat.groupBy("block_id").agg(*sums, F.max("last_updated").alias("last_updated"))
    return flat.na.fill(0, list(event_ids))


def score_stream(
    counts: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    anomalies_path: str,
    board_path: str,
    checkpoint: str,
    threshold: float = 0.5,
    top_n: int = 10,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    every: str | None = None,
) -> StreamingQuery:
    """Score the changed blocks of each micro-batch, store anomalies, refresh the board (ST4, ST5).

    The anomalies of a micro-batch are written under its number and read back
    for the board, so a batch is scored once and a repeated one changes nothing.
    """
    spark = counts.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        rows = above(scorer(batch.withColumnRenamed("last_updated", "detected_at")), threshold)
        target = f"{anomalies_path}/micro_batch={number}"
        rows.select("block_id", *event_ids, "anomaly_score", "detected_at").write.mode("overwrite").parquet(target)
        update_board(spark, board_path, spark.read.parquet(target), number, top_n, event_ids)

    writer = counts.writeStream.outputMode("update").foreachBatch(handle)
    return start(spark, writer, checkpoint, every)


def window_counts(
    lines: DataFrame,
    templates: Sequence[Template],
    time: str = "ts",
    length: str = "1 minute",
    slide: str | None = None,
    late: str | None = None,
) -> DataFrame:
    """Template counts per time window (ST6).

    Without ``late`` every row counts, however late, and its window is updated
    (update or complete mode). With it a window is final, and can be appended,
    once it is that much older than the newest row; later rows are dropped.
    """
    ids = event_order(dict(templates))
    matched = computed_once(lines, [time], event_id=first_match(F.col("line"), templates)).where(
        F.col("event_id").isNotNull()
    )
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        (matched.withWatermark(time, late) if late else matched)
        .groupBy(window.alias("w"))
        .agg(*[F.count_if(F.col("event_id") == e).alias(e) for e in ids])
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *ids)
    )


def label_windows(
    windows: DataFrame, lines: DataFrame, labels: DataFrame, time: str = "ts", length: str = "1 minute"
) -> DataFrame:
    """Mark each window 1 when a line of it names an anomalous block, else 0."""
    bad = labels.where(F.col("label") == "Anomaly").select("block_id").distinct()
    named = lines.select(F.window(time, length)["start"].alias("window_start"), tx.block_id(F.col("line")).alias("block_id"))
    hit = named.distinct().join(bad, "block_id", "left_semi").select("window_start").distinct()
    return windows.join(hit.withColumn("label", F.lit(1)), "window_start", "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )


class ProgressLog(StreamingQueryListener):
    """Keeps the last reports of the session's streams: rows, rate, counters (ST9)."""

    def __init__(self, keep: int = 100, report: Callable[[dict], None] | None = None) -> None:
        self.keep = keep
        self.report = report
        self.entries: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        entry = {
            "query": progress.name,
            "batch": progress.batchId,
            "rows": progress.numInputRows,
            "rows_per_second": progress.processedRowsPerSecond,
            "counters": {k: v.asDict() for k, v in progress.observedMetrics.items()},
        }
        self.entries = [*self.entries[-self.keep + 1 :], entry]
        if self.report:
            self.report(entry)

    def onQueryTerminated(self, event) -> None:
        pass
