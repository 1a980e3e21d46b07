"""CSV tables: matrix, labels, features, uploads, and the choice between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext as sq
from ..operators.features import unpivot_counts
from ..operators.labels import join_training
from ..schemas import DEFAULT_EVENTS, LABELS

BLOCK_NAMES = ("block_id", "BlockId")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all text, with one canonical block column name."""
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')
    # A byte-order mark sticks to the first header name.
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    for old, new in (("BlockId", "block_id"), ("Label", "label"), ("Type", "type")):
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _with_counts(df: DataFrame, event_ids: Sequence[str]) -> DataFrame:
    present = [e for e in event_ids if e in df.columns]
    counts = {e: F.expr(f"cast(try_cast({sq.name(e)} AS double) AS bigint)") for e in present}
    return df.withColumns(counts)


def read_matrix(
    spark: SparkSession,
    path: str,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    first: int | None = None,
    order_by: str = "block_id",
) -> DataFrame:
    """The wide matrix; ``first`` takes rows by an explicit order, not by file position."""
    df = _with_counts(require_columns(read_table(spark, path), ["block_id", *event_ids]), event_ids)
    return df.orderBy(order_by).limit(first) if first else df


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Block labels; a missing file means that no block is labelled."""
    try:
        return require_columns(read_table(spark, path), ["block_id", "label"]).select("block_id", "label")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LABELS)
        raise


def project_labels(df: DataFrame) -> DataFrame:
    return require_columns(df, ["block_id", "label"]).select("block_id", "label")


def read_upload(
    spark: SparkSession, path: str, batch_id: str, event_ids: Sequence[str] = DEFAULT_EVENTS
) -> DataFrame:
    """An uploaded wide CSV as long rows of one batch; absent event columns are skipped."""
    df = read_table(spark, path)
    present = [e for e in event_ids if e in df.columns]
    block = F.coalesce(F.col("block_id"), F.lit("")) if "block_id" in df.columns else F.lit("")
    wide = _with_counts(df.withColumn("block_id", block), present)
    return unpivot_counts(wide.select("block_id", *present), present).select(
        F.lit(batch_id).alias("batch_id"), "block_id", "event_id", "cnt"
    )


def first_valid_source(
    spark: SparkSession,
    matrix: str | None = None,
    training: str | None = None,
    features: str | None = None,
    labels: str | None = None,
    from_logs: Callable[[], DataFrame] | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> tuple[str, DataFrame]:
    """The first usable training source and its name.

    Order: the ready matrix, the ready training table, features joined with
    labels, and last the logs themselves.
    """
    wanted = {
        "matrix": ([matrix], ["block_id", "label", *event_ids]),
        "training": ([training], ["block_id", "target"]),
    }
    for name, (paths, columns) in wanted.items():
        df = _usable(spark, paths[0], columns)
        if df is not None:
            return name, _with_counts(df, event_ids)
    left = _usable(spark, features, ["block_id", *event_ids])
    right = _usable(spark, labels, ["block_id", "label"])
    if left is not None and right is not None:
        return "features", join_training(_with_counts(left, event_ids), right, event_ids)
    if from_logs is not None:
        return "logs", from_logs()
    raise FileNotFoundError("no usable training source")


def _usable(spark: SparkSession, path: str | None, columns: Sequence[str]) -> DataFrame | None:
    if not path:
        return None
    try:
        df = read_table(spark, path)
    except AnalysisException:
        return None
    if any(c not in df.columns for c in columns) or df.isEmpty():
        return None
    return df
