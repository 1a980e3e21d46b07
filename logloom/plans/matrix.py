"""Logs to matrix to training set (F1, F2, F16), and message ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.once import computed_once
from ..functions.patterns import Template, first_match
from ..operators.features import block_event_matrix
from ..operators.template_index import event_counts
from ..operators.labels import join_training, matrix_differences, with_default_labels
from ..schemas import DEFAULT_EVENTS, LABELS, event_order


def build_matrix(
    lines: DataFrame,
    templates: Sequence[Template],
    labels: DataFrame | None = None,
    mode: str = "literal",
    ordered: bool = True,
) -> DataFrame:
    """One row per block: label, anomaly type, count of every template.

    The counts are shuffled by block once, after map-side folding; the labels
    join on that partitioning. ``ordered`` adds the range shuffle of the final
    sort, which callers that store the matrix by key can leave out.
    """
    ids = event_order(dict(templates))
    counts = block_event_matrix(lines, templates, mode)
    known = labels if labels is not None else lines.sparkSession.createDataFrame([], LABELS)
    labelled = with_default_labels(counts, known, ids)
    return labelled.orderBy("block_id") if ordered else labelled


def build_counts(lines: DataFrame, templates: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The matrix in long form, for a table of templates of any size: ``block_id, label, event_id, cnt``."""
    counts = event_counts(lines, templates, key)
    named = labels.select("block_id", F.when(F.col("label") == "Anomaly", "Fail").otherwise("Success").alias("label"))
    return counts.join(named, "block_id", "left").withColumn("label", F.coalesce("label", F.lit("Success")))


def build_training_set(
    features: DataFrame, labels: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS
) -> DataFrame:
    return join_training(features, labels, event_ids)


def compare_matrices(mine: DataFrame, other: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS) -> DataFrame:
    return matrix_differences(mine, other, event_ids)


def ingest_messages(messages: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """``batch_id, line`` messages to ``block_event_stats`` rows.

    The time of a row is the newest time written in its lines.
    """
    text = F.col("line")
    parsed = computed_once(
        messages,
        ["batch_id"],
        block_id=tx.block_id(text),
        event_id=first_match(text, templates),
        ts=F.try_to_timestamp(F.substring(text, 1, 13), F.lit("yyMMdd HHmmss")).cast("timestamp_ntz"),
    ).where(F.col("block_id").isNotNull() & F.col("event_id").isNotNull())
    return parsed.groupBy("batch_id", "block_id", "event_id").agg(
        F.count("*").alias("cnt"), F.max("ts").alias("last_updated")
    )
