"""Writers (K1-K6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext as sq
from ..schemas import DEFAULT_EVENTS
from .numbering import numbered


def append_anomalies(df: DataFrame, path: str, scored: DataFrame | None = None) -> None:
    """Write scored rows by batch; running a batch again replaces that batch only.

    The rebalance gathers the rows of a batch into few files, and adaptive
    execution still splits a batch that is too large for one task. ``scored``
    lists the batches the rows come from: what is stored of one that has no rows
    any more is removed.
    """
    (
        df.hint("rebalance", "batch_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )
    if scored is not None:
        _drop_stale(df, path, scored)


def _drop_stale(df: DataFrame, path: str, scored: DataFrame) -> None:
    """Remove the folders of scored batches without rows; only batches that are stored and stale reach the driver."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    if not files.exists(root):
        return
    folders = {}
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("batch_id="):
            value = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[9:])
            folders[value] = status.getPath()
    stored = spark.createDataFrame([(b,) for b in folders], "batch_id string")
    stale = stored.join(scored.select(F.col("batch_id").cast("string")), "batch_id", "left_semi").join(
        df.select(F.col("batch_id").cast("string")), "batch_id", "left_anti"
    )
    for row in stale.toLocalIterator():
        files.delete(folders[row.batch_id], True)


def write_matrix(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The matrix sorted by block; CSV gets a header."""
    writer = df.orderBy("block_id").write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def export_rows(df: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS) -> DataFrame:
    """Flat rows for a CSV download: event columns as whole numbers, bad values 0."""
    fix = {
        e: F.expr(f"coalesce(cast(try_cast(cast({sq.name(e)} AS string) AS double) AS bigint), 0L)")
        for e in event_ids
        if e in df.columns
    }
    return df.withColumns(fix)


def write_export(df: DataFrame, path: str) -> None:
    """CSV lines under a header that starts with a byte-order mark.

    An export is a short, limited list, so it is one file.
    """
    header = df.columns
    named = df.toDF(*[("﻿" + c if i == 0 else c) for i, c in enumerate(header)])
    named.coalesce(1).write.mode("overwrite").csv(path, header=True)


def kafka_sink_options(servers: str, topic: str, acks: str = "1", compression: str = "gzip") -> dict[str, str]:
    """Options of a Kafka writer: batches of 64 KiB, a short linger, compressed."""
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": acks,
        "kafka.compression.type": compression,
        "kafka.batch.size": "65536",
        "kafka.linger.ms": "10",
        "kafka.retries": "3",
    }


def write_kafka(df: DataFrame, options: dict[str, str], column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.format("kafka").options(**options).save()


def split_lines(df: DataFrame, path: str, lines_per_file: int = 1_000_000, column: str = "value") -> None:
    """Text files of at most ``lines_per_file`` lines, in input order within each file.

    Any DataFrame; each task cuts its own lines. For exact cuts over files see ``split_files``.
    """
    (
        df.select(column)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", lines_per_file)
        .text(path)
    )


def split_files(spark: SparkSession, source: str | list[str], path: str, lines_per_file: int = 1_000_000) -> None:
    """Files of exactly ``lines_per_file`` lines in input order (the last may be shorter), in folders ``file_no=0, 1, ...``.

    The input files follow each other in order of their paths, however Spark
    splits them for reading. One shuffle brings the lines of a file together;
    its number of tasks is fixed, for it is the files that take time, not their size.
    """
    placed = numbered(spark.read.text(source), "_line").withColumn("file_no", F.expr(f"_line DIV {int(lines_per_file)}"))
    (
        placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_no")
        .sortWithinPartitions("file_no", "_line")
        .select("value", "file_no")
        .write.mode("overwrite")
        .partitionBy("file_no")
        .text(path)
    )


def write_unmatched(classified: DataFrame, path: str, mode: str = "append") -> None:
    """Lines no template explains, kept for inspection."""
    classified.where(F.col("match_type") != "template").select("line", "match_type").write.mode(mode).parquet(path)
