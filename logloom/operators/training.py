"""Splitting, weighting, training and evaluating a classifier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_EVENTS
from ..session import written_once
from ..sizing import is_small, literal_lookup
from .features import event_array
from .scoring import Scaler


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "block_id",
    test_share: float = 0.2,
    seed: int = 42,
    strata: bool = True,
) -> DataFrame:
    """Add ``part``: exactly ``ceil(share * n)`` rows of every label become the test set (M2).

    Rows are ordered by a hash of their key. Counts per label and hash prefix
    tell which prefix holds the cut, and only the keys that share it, about
    n / 65536 of a label, are sorted to find the cut itself. The split is then a
    comparison with the cut of the row's label, so that no wide row moves. Only
    rows with the very key of the cut are ranked, if not all of them fit.
    """
    group = F.coalesce(F.col(label).cast("string"), F.lit("")) if strata else F.lit("all")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    keys = df.select(group.alias("_group"), F.struct(digest.alias("hash"), F.col(key).alias("key")).alias("_place"))
    keys = keys.withColumn("_prefix", F.substring("_place.hash", 1, 4))
    sizes = keys.groupBy("_group", "_prefix").agg(F.count("*").alias("_rows"))
    per_label = Window.partitionBy("_group")
    before = per_label.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.ceil(F.sum("_rows").over(per_label) * F.lit(test_share)) - F.coalesce(F.sum("_rows").over(before), F.lit(0))
    # One row a label: the prefix in which its test rows end, and how many of them lie there.
    ends = written_once(
        sizes.withColumn("_wanted", wanted).where((F.col("_wanted") > 0) & (F.col("_wanted") <= F.col("_rows"))).drop("_rows"), "cuts"
    )
    inside = Window.partitionBy("_group", "_prefix").orderBy("_place")
    ranked = keys.join(ends, ["_group", "_prefix"]).withColumn("_rank", F.row_number().over(inside))
    same = ranked.groupBy("_group", "_wanted", "_place").agg(F.min("_rank").alias("_first"), F.max("_rank").alias("_last"))
    cuts = same.where("_wanted BETWEEN _first AND _last").select(
        F.col("_group").alias("_label"), F.col("_place").alias("_cut"), (F.col("_wanted") - F.col("_first") + 1).alias("_fit"),
        (F.col("_last") > F.col("_wanted")).alias("_split"),
    )
    cuts = written_once(cuts, "cuts")
    place = F.struct(digest.alias("hash"), F.col(key).alias("key"))
    marked = df.withColumns({"_group": group, "_place": place}).join(cuts, F.col("_group") == F.col("_label"), "left")
    chosen = F.coalesce(F.col("_place") <= F.col("_cut"), F.lit(False))
    if cuts.where("_split").isEmpty():
        return marked.select(*df.columns, F.when(chosen, "test").otherwise("train").alias("part"))
    at_cut = F.coalesce(F.col("_split") & (F.col("_place") == F.col("_cut")), F.lit(False))
    rest = marked.where(~at_cut).select(*df.columns, F.when(chosen, "test").otherwise("train").alias("part"))
    order = Window.partitionBy("_group").orderBy(F.xxhash64(*df.columns))
    tied = marked.where(at_cut).withColumn("_rank", F.row_number().over(order))
    return rest.union(tied.select(*df.columns, F.when(F.col("_rank") <= F.col("_fit"), "test").otherwise("train").alias("part")))


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Class sizes, the positive weight n0/n1 (1 when a class is empty) and 1/n per class (M3)."""
    sizes = df.agg(
        F.count_if(F.col(target) == 0).alias("n0"), F.count_if(F.col(target) == 1).alias("n1")
    )
    n0, n1 = F.col("n0"), F.col("n1")
    return sizes.select(
        "n0",
        "n1",
        F.when((n0 > 0) & (n1 > 0), n0 / n1).otherwise(F.lit(1.0)).alias("pos_weight"),
        F.when(n0 > 0, 1 / n0).alias("weight0"),
        F.when(n1 > 0, 1 / n1).alias("weight1"),
    )


def oversample(df: DataFrame, target: str = "target") -> DataFrame:
    """Repeat positive rows n0/n1 times, rounded: the classifier takes no row weights."""
    weight = class_weights(df, target).first()["pos_weight"]
    copies = F.when(F.col(target) == 1, F.lit(max(1, round(weight)))).otherwise(F.lit(1))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def _stages(train: DataFrame, event_ids: Sequence[str]) -> list[Transformer]:
    """The scaler, fitted on the training rows, and the assembler, as stages of a model."""
    scaler = Scaler.fit(train, event_ids)
    scaled = ", ".join(f"{text} AS z_{c}" for c, text in scaler.expressions().items())
    return [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"z_{c}" for c in event_ids], outputCol="features"),
    ]


def _assembled(rows: DataFrame, stages: Sequence[Transformer]) -> DataFrame:
    for stage in stages:
        rows = stage.transform(rows)
    return rows.select("features", F.col("target").cast("double").alias("target"))


def _classifier(event_ids: Sequence[str], hidden: Sequence[int], seed: int, iterations: int) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        layers=[len(event_ids), *hidden, 2],
        labelCol="target",
        featuresCol="features",
        seed=seed,
        maxIter=iterations,
        blockSize=512,
    )


def train_model(
    train: DataFrame,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    hidden: Sequence[int] = (64, 32),
    seed: int = 42,
    iterations: int = 100,
    balance: bool = True,
) -> PipelineModel:
    """Scale, assemble and fit a multilayer perceptron on rows with a 0/1 ``target`` (M1, M4).

    The scaler is fitted on the training rows only and becomes a stage of the
    saved model.
    """
    stages = _stages(train, event_ids)
    rows = _assembled(oversample(train) if balance else train, stages)
    return PipelineModel([*stages, _classifier(event_ids, hidden, seed, iterations).fit(rows)])


@dataclass(frozen=True)
class EarlyStop:
    """When training ends: after ``patience`` rounds of ``iterations`` without a gain of ``least`` in the held-out accuracy."""

    share: float = 0.1
    iterations: int = 10
    rounds: int = 50
    patience: int = 2
    least: float = 1e-4


def train_until_flat(
    train: DataFrame,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    hidden: Sequence[int] = (64, 32),
    seed: int = 42,
    balance: bool = True,
    early: EarlyStop = EarlyStop(),
) -> tuple[PipelineModel, list[float]]:
    """``train_model`` in rounds that go on from each other's weights, until a held-out part stops gaining (M4).

    ``early.share`` of the rows of every class are held out, as the split holds
    out test rows. Returns the model of the best round and the held-out accuracy
    of every round; the round of the best is where training would have ended.
    """
    split = written_once(stratified_split(train, "target", test_share=early.share, seed=seed + 1), "held")
    stages = _stages(train, event_ids)
    fit, held = split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part")
    rows = _assembled(oversample(fit) if balance else fit, stages).persist()
    judged = _assembled(held, stages).persist()
    weights, best, history = None, None, []
    try:
        while len(history) < early.rounds:
            classifier = _classifier(event_ids, hidden, seed, early.iterations)
            if weights is not None:
                classifier.setInitialWeights(weights)
            fitted = classifier.fit(rows)
            weights = fitted.weights
            right = F.avg((F.col("prediction") == F.col("target")).cast("double"))
            # A table too small to hold a row out is trained for one round.
            accuracy = fitted.transform(judged).agg(right).first()[0]
            history.append(accuracy if accuracy is not None else 1.0)
            if best is None or history[-1] > best[0] + early.least:
                best = (history[-1], len(history) - 1, fitted)
            elif len(history) - 1 - best[1] >= early.patience or accuracy is None:
                break
    finally:
        rows.unpersist()
        judged.unpersist()
    return PipelineModel([*stages, best[2]]), history


def score_model(
    df: DataFrame, model: PipelineModel, event_ids: Sequence[str] = DEFAULT_EVENTS
) -> DataFrame:
    """Add ``anomaly_score``, the probability of the positive class (M5)."""
    scored = model.transform(df)
    probability = vector_to_array("probability").getItem(1)
    return scored.select(*df.columns, probability.alias("anomaly_score"))


def detect_events(
    scored: DataFrame, threshold: float, templates: dict[str, str], event_ids: Sequence[str] = DEFAULT_EVENTS
) -> DataFrame:
    """Blocks above the threshold with ``events: [{event_id, template, count}]`` (M6)."""
    events = F.transform(
        event_array(event_ids),
        lambda x: F.struct(
            x["event_id"].alias("event_id"),
            literal_lookup(x["event_id"], templates, "Unknown").alias("template"),
            x["count"].alias("count"),
        ),
    )
    hit = scored.where(F.col("anomaly_score") > threshold)
    return hit.select("block_id", F.col("anomaly_score").alias("probability"), events.alias("events"))


def confusion(predictions: DataFrame, label: str = "target", predicted: str = "predicted") -> DataFrame:
    """The four cells of the confusion matrix as one row."""
    y, p = F.col(label), F.col(predicted)
    return predictions.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def classification_report(predictions: DataFrame, label: str = "target", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, with the accuracy (A15); a zero division counts 0."""

    def share(part, whole):
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    cells = confusion(predictions, label, predicted)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def row(target, right, missed, wrong):
        return F.struct(
            F.lit(target).alias("target"),
            share(right, right + wrong).alias("precision"),
            share(right, right + missed).alias("recall"),
            share(2 * right, 2 * right + missed + wrong).alias("f1"),
            (right + missed).alias("support"),
            share(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        )

    return cells.select(F.inline(F.array(row(0, tn, fp, fn), row(1, tp, fn, fp))))


def feature_importance(
    spark: SparkSession, model: PipelineModel, event_ids: Sequence[str] = DEFAULT_EVENTS, n: int = 10
) -> DataFrame:
    """Mean absolute first-layer weight per feature (M7).

    The weights are the model's own, a few thousand numbers whatever the data.
    """
    net: MultilayerPerceptronClassificationModel = model.stages[-1]
    width = net.getOrDefault("layers")[1]
    flat = net.weights.toArray()
    rows = []
    for i, event in enumerate(event_ids):
        own = flat[i * width : (i + 1) * width]
        rows.append((event, float(abs(own).mean())))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(n)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_or_train(spark: SparkSession, path: str, train, **options) -> tuple[PipelineModel, bool]:
    """The stored model, or one trained now and stored (M9, K7).

    ``train`` is called for the training rows only when they are needed.
    """
    try:
        spark.read.text(f"{path}/metadata")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        model = train_model(train(), **options)
        save_model(model, path)
        return model, True
    return PipelineModel.load(path), False


def can_stratify(df: DataFrame, label: str = "label") -> bool:
    """False when a class has a single row; the split then ignores the classes."""
    return is_small(df.groupBy(label).count().where("count < 2"), 0)
