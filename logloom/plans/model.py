"""Training and detection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiers
from ..operators.features import event_array, event_text
from ..operators.ordering import ranked
from ..operators.training import (
    EarlyStop,
    can_stratify,
    classification_report,
    confusion,
    feature_importance,
    save_model,
    score_model,
    stratified_split,
    train_model,
    train_until_flat,
)
from ..schemas import DEFAULT_EVENTS
from ..session import written_once


def detection_summary(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Blocks, anomalies above the threshold, their ratio, and how many a list of ten leaves out."""
    hits = F.count_if(F.col("anomaly_score") > threshold)
    counts = scored.agg(F.count("*").alias("total"), hits.alias("anomalies"))
    return counts.select(
        "total",
        "anomalies",
        tiers.ratio(F.col("anomalies"), F.col("total")).alias("anomaly_ratio"),
        F.lit(threshold).alias("threshold"),
        F.greatest(F.col("anomalies") - 10, F.lit(0)).cast("bigint").alias("not_listed"),
    )


def detection_list(
    scored: DataFrame,
    threshold: float = 0.3,
    n: int = 10,
    order: Sequence[Column] | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
) -> DataFrame:
    """The highest scores with position, verdict and ``E5:3`` texts; ``order`` breaks ties."""
    by = order or [F.desc("anomaly_score"), F.col("block_id")]
    top = ranked(scored.where(F.col("anomaly_score") > threshold), by, n)
    return top.select(
        "position",
        "block_id",
        "anomaly_score",
        tiers.target_label((F.col("anomaly_score") > threshold).cast("int")).alias("prediction"),
        event_text(event_array(event_ids)).alias("events"),
    )


def detect(
    matrix: DataFrame, model: PipelineModel, threshold: float = 0.3, event_ids: Sequence[str] = DEFAULT_EVENTS
) -> tuple[DataFrame, DataFrame]:
    """Summary and list for a matrix under a trained model (F14); all rows are scored."""
    scored = score_model(matrix, model, event_ids)
    return detection_summary(scored, threshold), detection_list(scored, threshold, event_ids=event_ids)


@dataclass(frozen=True)
class Training:
    model: PipelineModel
    report: DataFrame
    confusion: DataFrame
    importance: DataFrame
    #: Held-out accuracy by round, when training ended early.
    history: tuple[float, ...] = ()


def train_and_evaluate(
    training: DataFrame,
    path: str | None = None,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    seed: int = 42,
    threshold: float = 0.5,
    early: EarlyStop | None = None,
    **options,
) -> Training:
    """Split, fit on the training part, judge on the test part, store the model.

    With ``early`` a part of the training rows decides when training ends.

    The split is written to the shared scratch folder once: scaling, weighting,
    fitting and judging all read it, and a lost executor does not redo it.
    """
    known = training.where(F.col("target").isNotNull())
    split = stratified_split(known, "target", seed=seed, strata=can_stratify(known, "target"))
    parts = written_once(split, "split")
    rows, history = parts.where("part = 'train'").drop("part"), []
    if early:
        model, history = train_until_flat(rows, event_ids, seed=seed, early=early, **options)
    else:
        model = train_model(rows, event_ids, seed=seed, **options)
    if path:
        save_model(model, path)
    test = score_model(parts.where("part = 'test'").drop("part"), model, event_ids)
    judged = test.withColumn("predicted", (F.col("anomaly_score") > threshold).cast("int"))
    return Training(
        model,
        classification_report(judged),
        confusion(judged),
        feature_importance(training.sparkSession, model, event_ids),
        tuple(history),
    )
