from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators import aggregates as ag
from logloom.operators import anomalies as an
from logloom.operators import leaderboard as lb
from logloom.plans import batch_jobs as bj
from logloom.plans import reports as rp
from logloom.sizing import lookup

NOW = datetime(2024, 1, 10, 12, 0, 0)
IDS = ["E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8"]


def anomaly_rows(spark, rows):
    """(batch, block, score, hours ago, counts)"""
    data = [(b, k, *[counts.get(e, 0) for e in IDS], s, NOW - timedelta(hours=h)) for b, k, s, h, counts in rows]
    fields = ", ".join(f"{e} long" for e in IDS)
    return spark.createDataFrame(data, f"batch_id string, block_id string, {fields}, anomaly_score double, detected_at timestamp_ntz")


@pytest.fixture(scope="module")
def anomalies(spark):
    many = {e: i + 1 for i, e in enumerate(IDS)}
    return anomaly_rows(
        spark,
        [("1", "a", 0.9, 0.5, {"E1": 2, "E3": 5}), ("1", "a", 0.7, 0.1, {"E1": 1}), ("1", "b", 0.9, 0.9, many),
         ("2", "c", 0.6, 30, {"E2": 1}), ("2", "d", 0.95, 200, {}), ("2", "a", 0.8, 5, {"E2": 9})],
    )


@pytest.fixture(scope="module")
def stats(spark):
    rows = [("1", "a", "E1", 3, NOW), ("1", "b", "E2", 3, NOW - timedelta(hours=2)), ("2", "c", "E1", 1, NOW - timedelta(days=3)),
            ("2", "a", "E3", 2, NOW - timedelta(minutes=5))]
    return spark.createDataFrame(rows, "batch_id string, block_id string, event_id string, cnt long, last_updated timestamp_ntz")


def test_range_precedence():
    assert an.range_seconds() == 3600
    assert an.range_seconds(seconds=5, minutes=1, hours=1, days=1) == 5
    assert an.range_seconds(minutes=2, hours=1) == 120
    assert an.range_seconds(hours=2, days=9) == 7200 and an.range_seconds(days=1) == 86400


def test_recent_orders_ties_by_block_and_keeps_event_order(anomalies):
    rows = rp.recent_anomalies(anomalies, hours=1, as_of=F.lit(NOW), event_ids=IDS).collect()
    assert [(r.block_id, r.anomaly_score) for r in rows] == [("a", 0.9), ("b", 0.9), ("a", 0.7)]
    assert [tuple(e) for e in rows[0].events] == [("E1", 2), ("E3", 5)]


def test_now_is_the_default_anchor(spark):
    df = spark.range(1).select(F.current_timestamp().alias("t"))
    assert an.since(df, "t", None, 60).count() == 1
    old = spark.createDataFrame([(datetime(2001, 1, 1),)], "t timestamp_ntz")
    assert an.since(old, "t", None, 60).count() == 0


def test_query_and_its_distribution(stats, anomalies):
    report = rp.query_anomalies(stats, anomalies, limit=2, days=2, as_of=F.lit(NOW), event_ids=IDS)
    assert [r.block_id for r in report.rows.collect()] == ["a", "b"]
    assert [tuple(r) for r in report.distribution.collect()] == [("E1", 3), ("E2", 3), ("E3", 2)]
    assert report.summary.first().anomaly_count == 2
    legacy = rp.query_anomalies(stats, anomalies, days=2, as_of=F.lit(NOW), legacy_window=True, event_ids=IDS)
    assert [tuple(r) for r in legacy.distribution.collect()] == [("E1", 3), ("E3", 2)]


def test_analyze(stats, anomalies):
    report = rp.analyze(stats, anomalies, as_of=F.lit(NOW), event_ids=IDS)
    s = report.summary.first()
    assert (s.total_blocks, s.anomaly_count, s.listed_count, s.anomaly_ratio, s.listed_ratio) == (3, 2, 3, 0.6667, 1.0)
    first = report.rows.collect()[0]
    assert first.label == "anomaly" and [tuple(e) for e in first.events] == [("E3", 5), ("E1", 2)]
    assert ag.distribution_map(report.distribution).first().event_distribution == {"E1": 4, "E2": 3, "E3": 2}


def test_empty_inputs(spark, stats, anomalies):
    none = anomalies.where("false")
    s = rp.analysis_summary(stats.where("false"), none, F.lit(NOW)).first()
    assert (s.total_blocks, s.anomaly_count, s.anomaly_ratio) == (0, 0, 0.0)
    h = rp.system_health(stats.where("false"), none, F.lit(NOW)).first()
    assert (h.health_percent, h.status) == (100.0, "excellent")
    assert rp.realtime_anomalies(stats, none, None, event_ids=IDS).source == "none"


def test_best_row_per_block(anomalies):
    best = {r.block_id: r.anomaly_score for r in an.best_per_block(anomalies).collect()}
    assert best == {"a": 0.9, "b": 0.9, "c": 0.6, "d": 0.95}


def test_rank_limit_runs_before_the_shuffle(anomalies):
    plan = an.best_per_block(anomalies)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan


def test_boards(anomalies):
    latest = [(r.block_id, r.anomaly_score) for r in lb.leaderboard(anomalies, 3, event_ids=IDS).collect()]
    assert latest == [("d", 0.95), ("b", 0.9), ("a", 0.7)]
    best = lb.leaderboard(anomalies, 3, "max", IDS)
    assert [(r.block_id, r.anomaly_score) for r in best.collect()] == [("d", 0.95), ("b", 0.9), ("a", 0.9)]
    assert best.where("block_id = 'a'").first().E3 == 5
    live = lb.expire_details(best, F.lit(NOW), event_ids=IDS).where("block_id = 'd'").first()
    assert live.E1 is None and lb.expire_details(best, F.lit(NOW), drop=True).count() == 2
    with pytest.raises(ValueError):
        lb.leaderboard(anomalies, 3, "mean", IDS)


def test_board_serves_open_questions_only(stats, anomalies):
    board = lb.leaderboard(anomalies, 2, event_ids=IDS)
    report = rp.realtime_anomalies(stats, anomalies, board, event_ids=IDS)
    assert report.source == "leaderboard" and report.rows.count() == 2
    assert report.summary.first().source == "leaderboard"
    ranged = rp.realtime_anomalies(stats, anomalies, board, hours=1, as_of=F.lit(NOW), event_ids=IDS)
    assert ranged.source == "table" and ranged.rows.count() == 3


def test_synced_board_needs_a_new_row(anomalies):
    board = bj.sync_leaderboard(anomalies, F.lit(NOW - timedelta(hours=1)), event_ids=IDS)
    assert [r.block_id for r in board.collect()] == ["b", "a"]


def test_dashboard(stats, anomalies):
    report = rp.dashboard(stats, anomalies, hours=1, as_of=F.lit(NOW), event_ids=IDS)
    rows = {(r.block_id, r.probability): r for r in report.rows.collect()}
    assert rows[("b", 0.9)].more == 2 and len(rows[("b", 0.9)].events) == 6
    totals = {r.event_id: r.total_count for r in report.distribution.collect()}
    assert totals["E1"] == 2 + 1 + 1 and totals["E8"] == 8
    assert report.summary.first().anomaly_count == 3


def test_dashboard_falls_back_to_common_events(stats, anomalies):
    board = lb.expire_details(lb.leaderboard(anomalies, 2, event_ids=IDS), F.lit(NOW + timedelta(days=1)), event_ids=IDS)
    report = rp.dashboard(stats, anomalies, board, hours=None, event_ids=IDS)
    events = [[tuple(e) for e in r.events] for r in report.rows.collect()]
    assert events == [[("E1", 4), ("E2", 3), ("E3", 2)]] * 2


def test_top_events_with_bars(spark):
    df = spark.createDataFrame([("a", 3, 10, 0), ("b", 0, 0, 0)], "block_id string, E1 long, E2 long, E3 long")
    got = [tuple(r) for r in an.top_events(df, ["E1", "E2", "E3"]).collect()]
    assert got == [("a", 1, "E2", 10, 10), ("a", 2, "E1", 3, 3)]


def test_batch_anomalies_of_one_batch(spark, anomalies):
    meanings = spark.createDataFrame([("E1", "one")], "event_id string, meaning string")
    got = [(r.block_id, r.event_rank, r.event_id, r.meaning) for r in bj.batch_anomalies(anomalies, "2", meanings, event_ids=IDS).collect()]
    assert sorted(got) == [("a", 1, "E2", "Unknown"), ("c", 1, "E2", "Unknown")]


def test_batch_list_and_report(stats, anomalies):
    rows = {r.batch_id: r for r in ag.batch_list(stats, None).collect()}
    assert (rows["1"].row_count, rows["1"].block_count, rows["1"].risk) == (2, 2, "normal")
    assert [r.batch_id for r in ag.batch_list(stats, 1).collect()] == ["2"]
    report = {r.batch_id: r.anomaly_count for r in ag.batch_report(stats, anomalies.where("batch_id = '1'")).collect()}
    assert report == {"1": 3, "2": 0}
    totals = ag.batch_totals(ag.batch_list(stats)).first()
    assert tuple(totals) == (2, 4, 4)
    assert ag.total_blocks(stats, approximate=True).first().total_blocks == 3


def test_export_coerces_bad_counts(spark):
    from logloom.sources.sinks import export_rows

    df = spark.createDataFrame([("a", "3", "x", None), ("b", "2.7", "", "1")], "block_id string, E1 string, E2 string, E3 string")
    assert [tuple(r) for r in export_rows(df, ["E1", "E2", "E3"]).collect()] == [("a", 3, 0, 0), ("b", 2, 0, 1)]


def test_export_prefers_the_board(anomalies):
    board = lb.leaderboard(anomalies, 10, event_ids=IDS)
    assert rp.export_anomalies(anomalies, board, IDS).columns == ["block_id", "anomaly_score", "detected_at", *IDS]
    table = rp.export_anomalies(anomalies, board.where("false"), IDS)
    assert "detected_at" in table.columns and table.count() == 6


def test_lookup_of_missing_repeated_and_null_keys(spark, values):
    df = spark.createDataFrame([("E1",), ("E9",), (None,)], "event_id string")
    rows = [("E1", "one"), ("E1", "two"), (None, "null")]
    dim = spark.createDataFrame(rows, "event_id string, text string")
    got = values(lookup(df, dim, "event_id", "text", "t", "Unknown"), "event_id", "t")
    assert got == [("E1", "one"), ("E9", "Unknown"), (None, "Unknown")]


def test_listed_totals_and_severity(anomalies):
    top = an.top_anomalies(anomalies, 3)
    got = [(r.event_id, r.total_count) for r in an.listed_event_totals(top, IDS, 2).collect()]
    assert got == [("E3", 8), ("E8", 8)]
    assert {r.severity for r in an.with_severity(anomalies).collect()} == {"high", "medium"}
    assert an.with_events(top, IDS).columns[-1] == "events"
