"""Labels and matrix comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as sq
from ..functions.tiers import anomaly_type, label_target
from ..schemas import DEFAULT_EVENTS


def with_default_labels(
    features: DataFrame, labels: DataFrame, event_ids: Sequence[str]
) -> DataFrame:
    """Label every block: Fail for a known anomaly, else Success (J2); failed blocks get a type.

    A block listed more than once is an anomaly if any of its rows says so.
    """
    known = labels.groupBy("block_id").agg(F.bool_or(F.col("label") == "Anomaly").alias("_failed"))
    joined = features.join(known, "block_id", "left")
    failed = F.coalesce(F.col("_failed"), F.lit(False))
    return joined.select(
        "block_id",
        F.when(failed, "Fail").otherwise("Success").alias("label"),
        F.when(failed, anomaly_type(event_ids)).alias("type"),
        *event_ids,
    )


def join_training(
    features: DataFrame, labels: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS
) -> DataFrame:
    """Labelled blocks with a 0/1 target, in a fixed column order (F2)."""
    named = labels.select("block_id", "label")
    joined = features.drop("label").join(named, "block_id")
    return joined.withColumn("target", label_target(F.col("label"))).select(
        "block_id", "label", "target", *event_ids
    )


def matrix_differences(
    mine: DataFrame, other: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS
) -> DataFrame:
    """Per event the number of common blocks whose counts differ, and a total.

    A missing count differs from everything, also from a missing count.
    """
    a, b = mine.alias("a"), other.alias("b")
    joined = a.join(b, F.col("a.block_id") == F.col("b.block_id"))

    differing = [
        F.expr(f"count_if(coalesce(a.{sq.name(e)} <> b.{sq.name(e)}, true)) AS {sq.name(e)}") for e in event_ids
    ]
    sums = joined.agg(F.count("*").alias("common_blocks"), *differing)
    totalled = sums.withColumn("total", F.expr(" + ".join(map(sq.name, event_ids))))
    return totalled.unpivot(["common_blocks"], [*event_ids, "total"], "event_id", "mismatches")


def class_balance(training: DataFrame) -> DataFrame:
    return training.groupBy("target").agg(F.count("*").alias("rows"))
