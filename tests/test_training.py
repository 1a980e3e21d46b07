import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import scoring as sc
from logloom.operators import training as tr
from logloom.plans.model import detect, train_and_evaluate

IDS = ["E1", "E2", "E3"]


@pytest.fixture(scope="module")
def training(spark):
    """One class is rare; E2 tells the classes apart, E3 is constant."""
    rows = [(f"blk_{i}", "Fail" if i % 10 == 0 else "Success", int(i % 10 == 0), i % 4, 9 if i % 10 == 0 else i % 3, 7) for i in range(300)]
    return spark.createDataFrame(rows, "block_id string, label string, target int, E1 long, E2 long, E3 long")


def test_scaler_uses_the_population_deviation_and_zeroes_constants(spark, training):
    data = training.select(*IDS).toPandas().to_numpy(dtype=float)
    stats = {r.feature: r for r in sc.scaler_stats(training, IDS).collect()}
    assert stats["E1"].std == pytest.approx(data[:, 0].std()) and stats["E1"].mean == pytest.approx(data[:, 0].mean())
    scaled = sc.Scaler.fit(training, IDS).apply(training).toPandas()
    assert scaled["z_E1"].to_numpy() == pytest.approx((data[:, 0] - data[:, 0].mean()) / data[:, 0].std())
    assert set(scaled["z_E3"]) == {0.0}


def test_scaler_reads_a_missing_count_as_zero(spark):
    scaler = sc.Scaler(("E1",), (2.0,), (4.0,))
    df = spark.createDataFrame([(None,), (4,)], "E1 long")
    assert sorted(r.z_E1 for r in scaler.apply(df).collect()) == [-0.5, 0.5]


def net_of(shape, seed=3):
    rng = np.random.default_rng(seed)
    layers = []
    for a, b in zip(shape, shape[1:]):
        layers.append((tuple(map(tuple, rng.normal(size=(a, b)).tolist())), tuple(rng.normal(size=b).tolist())))
    return sc.Network(tuple(layers))


def forward(net, x):
    for depth, (m, b) in enumerate(net.layers):
        x = np.array(x) @ np.array(m) + np.array(b)
        x = np.maximum(x, 0) if depth < len(net.layers) - 1 else x
    return 1 / (1 + math.exp(-x[0]))


@pytest.mark.parametrize("shape", [(3, 4, 2, 1), (3, 64, 32, 1)])
def test_networks_equal_numpy(spark, training, shape):
    net = net_of(shape)
    scored = training.select(*IDS, sc.network_score([F.col(e) for e in IDS], net).alias("s"))
    for row in scored.limit(20).collect():
        assert row.s == pytest.approx(forward(net, [row.E1, row.E2, row.E3]))


def test_linear_score(spark):
    df = spark.createDataFrame([(2, 1)], "E1 long, E2 long")
    assert df.select(sc.linear_score({"E1": 0.5, "E2": -1.0}, 0.0).alias("s")).first().s == 0.5


def test_split_is_exact_per_label_and_repeatable(spark, training):
    parts = tr.stratified_split(training, "label").select("block_id", "label", "part")
    rows = parts.collect()
    for label in ("Fail", "Success"):
        keys = [r.block_id for r in training.where(F.col("label") == label).collect()]
        ordered = sorted(keys, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
        want = set(ordered[: math.ceil(len(keys) * 0.2)])
        assert {r.block_id for r in rows if r.label == label and r.part == "test"} == want
    assert sorted(rows) == sorted(parts.repartition(7).collect())
    assert tr.stratified_split(training, "label", strata=False).where("part = 'test'").count() == 60


def test_split_of_tiny_classes(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "block_id string, label string")
    assert not tr.can_stratify(df) and tr.can_stratify(df.where("label = 'y'"))
    assert tr.stratified_split(df).where("part = 'test'").count() == 2


def test_weights_and_oversampling(spark, training):
    row = tr.class_weights(training).first()
    assert (row.n0, row.n1, row.pos_weight) == (270, 30, 9.0)
    counts = {r.target: r["count"] for r in tr.oversample(training).groupBy("target").count().collect()}
    assert counts == {0: 270, 1: 270}
    empty = tr.class_weights(training.where("target = 0")).first()
    assert (empty.pos_weight, empty.weight1) == (1.0, None)


def test_report_counts_zero_divisions_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "target int, predicted int")
    rows = {r.target: r for r in tr.classification_report(df).collect()}
    assert (rows[1].precision, rows[1].recall, rows[1].f1, rows[1].support) == (0.0, 0.0, 0.0, 2)
    assert rows[0].precision == pytest.approx(1 / 3) and rows[0].accuracy == pytest.approx(1 / 3)
    assert tuple(tr.confusion(df).first()) == (1, 0, 2, 0)


def test_train_store_load_and_detect(spark, training, tmp_path):
    path = str(tmp_path / "model")
    done = train_and_evaluate(training, path, IDS, hidden=(6, 4), iterations=60)
    report = {r.target: r for r in done.report.collect()}
    assert report[1].f1 > 0.9 and report[0].f1 > 0.9
    assert done.importance.first().feature in IDS and done.importance.count() == 3
    loaded, trained = tr.load_or_train(spark, path, lambda: pytest.fail("must not train"))
    assert not trained
    summary, listed = detect(training, loaded, 0.5, IDS)
    s = summary.first()
    assert (s.total, s.anomalies, s.not_listed, s.threshold) == (300, 30, 20, 0.5)
    assert [r.position for r in listed.collect()] == list(range(1, 11))
    found = tr.detect_events(tr.score_model(training, loaded, IDS), 0.5, {"E1": "one"}, IDS)
    row = found.where("block_id = 'blk_10'").first()
    assert [tuple(e) for e in row.events] == [("E1", "one", 2), ("E2", "Unknown", 9), ("E3", "Unknown", 7)]
    _, trained = tr.load_or_train(spark, str(tmp_path / "other"), lambda: training, event_ids=IDS, hidden=(2,), iterations=2)
    assert trained


def test_split_moves_no_wide_row_and_ranks_ties(spark):
    rows = [(i, "x" * 50, i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "block_id long, wide string, label boolean")
    found = tr.stratified_split(df)
    assert "wide" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r.n) for r in found.where("part = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()} == {(True, 34), (False, 67)}
    same = df.withColumn("block_id", F.col("block_id") % 2)
    tied = tr.stratified_split(same)
    assert {(r.label, r.n) for r in tied.where("part = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()} == {(True, 34), (False, 67)}
    assert tied.drop("part").exceptAll(same).isEmpty() and tied.count() == 500
    nulls = tr.stratified_split(df.withColumn("label", F.when(F.col("block_id") < 400, F.lit("a"))).withColumn("block_id", F.when(F.col("block_id") > 3, F.col("block_id"))))
    assert {(r.label, r.n) for r in nulls.where("part = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()} == {("a", 80), (None, 20)}


def test_training_ends_when_the_held_out_part_stops_gaining(spark, training):
    early = tr.EarlyStop(share=0.2, iterations=3, rounds=12, patience=2)
    model, history = tr.train_until_flat(training, IDS, hidden=(6,), early=early)
    best = max(range(len(history)), key=lambda i: (history[i], -i))
    assert history[best] > 0.95 and len(history) <= 12
    # No later round gains, and two rounds were waited for unless the rounds ran out.
    assert len(history) == 12 or len(history) - 1 - best >= 2
    scored = tr.score_model(training, model, IDS).withColumn("predicted", (F.col("anomaly_score") > 0.5).cast("int"))
    assert scored.where("predicted = target").count() > 285
    again, same = tr.train_until_flat(training, IDS, hidden=(6,), early=early)
    assert same == history and (again.stages[-1].weights.toArray() == model.stages[-1].weights.toArray()).all()


def test_a_table_without_rows_to_hold_out_is_trained_once(spark, training):
    few = training.limit(1).union(training.where("target = 1").limit(1))
    _, history = tr.train_until_flat(few, IDS, hidden=(2,), early=tr.EarlyStop(share=0.0))
    assert history == [1.0] or len(history) == 2
