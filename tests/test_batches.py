from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom import adapters as ad
from logloom.operators import batches as bt
from logloom.plans import batch_jobs as bj
from logloom.schemas import DEFAULT_EVENTS
from logloom.session import scratch_dir
from logloom.streaming.board import clear_board, read_board, update_board


def scorer(df):
    return df.withColumn("anomaly_score", ad.score_expression())


@pytest.fixture(scope="module")
def stats(spark):
    return ad.block_event_stats(ad.table(spark, "/root/testdata/sf0.001", "events"))


def test_pending_ignores_a_null_on_the_right(spark, values):
    stats = spark.createDataFrame([("1",), ("1",), ("2",)], "batch_id string")
    done = spark.createDataFrame([("2",), (None,)], "batch_id string")
    assert values(bt.pending_batches(stats, done)) == [("1",)]
    assert values(bt.difference(stats, done, "batch_id")) == [("1",)]


def test_offline_jobs_are_idempotent_and_remember_quiet_batches(spark, stats, values, tmp_path):
    paths = (str(tmp_path / "anomalies"), str(tmp_path / "ledger"))
    quiet = spark.createDataFrame([("quiet", "blk_1", "E9", 5, datetime(2024, 1, 1))], stats.schema)
    todo = bj.process_offline_batches(stats.unionByName(quiet), *paths, scorer)
    assert todo.where("batch_id = 'quiet'").count() == 1
    first = values(spark.read.parquet(paths[0]).select("batch_id", "block_id", "anomaly_score"))
    want = values(ad.anomaly_blocks(stats).select("batch_id", "block_id", "anomaly_score"))
    assert [tuple(map(str, r)) for r in first] == [tuple(map(str, r)) for r in want]
    again = bj.process_offline_batches(stats.unionByName(quiet), *paths, scorer)
    assert again.count() == 0
    one = stats.select("batch_id").first()[0]
    bj.process_offline_batches(stats, *paths, scorer, batch_id=one)
    assert values(spark.read.parquet(paths[0]).select("batch_id", "block_id", "anomaly_score")) == first


def test_listed_and_joined_batches_agree(spark, stats, values):
    chosen = stats.select("batch_id").distinct().limit(3)
    ids = [r.batch_id for r in chosen.collect()]
    fixed = spark.createDataFrame([(i,) for i in ids], "batch_id string")
    assert values(bj.of_batches(stats, fixed)) == values(bj.of_batches(stats, fixed, limit=1))


def test_incremental_paths_agree_and_use_full_history(spark, values):
    t = datetime(2024, 1, 1)
    rows = [("1", "a", "E1", 1, t), ("2", "a", "E1", 2, t + timedelta(hours=2)), ("1", "b", "E1", 9, t), ("1", "c", "E2", 1, t + timedelta(hours=1))]
    stats = spark.createDataFrame(rows, "batch_id string, block_id string, event_id string, cnt long, last_updated timestamp_ntz")
    mark = F.lit(t + timedelta(hours=1)).cast("timestamp_ntz")
    small = bt.incremental_features(stats, mark, ["E1", "E2"])
    assert values(small, "block_id", "E1", "E2") == [("a", 3, 0)]
    assert values(bt.incremental_features(stats, mark, ["E1", "E2"], broadcast_blocks=0)) == values(small)


def test_incremental_rounds(spark, stats, tmp_path):
    where = [str(tmp_path / n) for n in ("anomalies", "board", "mark")]
    half = stats.where("last_updated < timestamp_ntz'2024-01-16 00:00:00'")
    start = datetime(2020, 1, 1)
    assert bj.run_incremental(half, *where, scorer, start, threshold=0.2) is not None
    before = spark.read.parquet(where[0]).count()
    assert bj.run_incremental(half, *where, scorer, start, threshold=0.2) is None
    assert bj.run_incremental(stats, *where, scorer, start, threshold=0.2) is not None
    assert spark.read.parquet(where[0]).count() > before
    newest = bj.sync_leaderboard(spark.read.parquet(where[0]))
    board = read_board(spark, where[1])
    assert board.count() == min(10, newest.count())


def board_rows(spark, rows):
    t = datetime(2024, 1, 1)
    data = [(k, *([n] * 29), s, t + timedelta(minutes=m)) for k, s, n, m in rows]
    fields = ", ".join(f"{e} int" for e in DEFAULT_EVENTS)
    return spark.createDataFrame(data, f"block_id string, {fields}, anomaly_score double, detected_at timestamp_ntz")


def test_stored_board_replaces_scores_and_survives_repeats(spark, tmp_path):
    path = str(tmp_path / "board")
    assert read_board(spark, path) is None
    update_board(spark, path, board_rows(spark, [("a", 0.9, 1, 0), ("b", 0.8, 1, 0), ("c", 0.7, 1, 0)]), 0, n=2)
    show = lambda: [(r.block_id, r.anomaly_score) for r in read_board(spark, path).orderBy(F.desc("anomaly_score")).collect()]
    assert show() == [("a", 0.9), ("b", 0.8)]
    for _ in range(2):
        update_board(spark, path, board_rows(spark, [("a", 0.3, 2, 5), ("d", 0.85, 1, 5), ("d", 0.99, 1, 4)]), 1, n=2)
        assert show() == [("d", 0.85), ("b", 0.8)]
    for version in range(2, 12):
        update_board(spark, path, board_rows(spark, [("e", 0.5 + version / 100, 1, 5 + version)]), version, n=2)
    assert show() == [("d", 0.85), ("b", 0.8)]
    update_board(spark, path, board_rows(spark, []), 12, n=2)
    assert show() == [("d", 0.85), ("b", 0.8)]


def test_deletes_need_confirmation_and_drop_partitions(spark):
    rows = [("1", "a"), ("2", "b"), ("3", "c")]
    for name in ("stats_t", "anomalies_t"):
        spark.createDataFrame(rows, "batch_id string, block_id string").write.mode("overwrite").partitionBy("batch_id").saveAsTable(name)
    tables = ["stats_t", "anomalies_t"]
    with pytest.raises(ValueError):
        bt.delete_batches(spark, tables, ["1"])
    report = bt.delete_batches(spark, [*tables, "missing_t"], ["1", "x' or 1=1"], confirm=True).collect()
    assert [(r.table_name, r.deleted) for r in report] == [("stats_t", True), ("anomalies_t", True), ("missing_t", False), (None, False)]
    assert [spark.table(t).count() for t in tables] == [2, 2]
    bt.delete_all_batches(spark, tables, confirm=True)
    assert [spark.table(t).count() for t in tables] == [0, 0]


def test_clearing_a_board(spark, stats, tmp_path):
    where = [str(tmp_path / n) for n in ("anomalies", "board", "mark")]
    start = datetime(2020, 1, 1)
    first = bj.run_incremental(stats, *where, scorer, start, threshold=0.2)
    with pytest.raises(ValueError):
        clear_board(spark, where[1])
    clear_board(spark, where[1], where[2], confirm=True)
    assert read_board(spark, where[1]) is None
    assert bj.run_incremental(stats, *where, scorer, start, threshold=0.2) == first
    assert read_board(spark, where[1]).count() == 10


def test_scratch_folder_follows_the_session(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_counts_are_summed_without_an_exchange(spark, small, values, tmp_path):
    stats = ad.block_event_stats(ad.table(spark, small, "events"))
    mark = F.expr("timestamp_ntz'2024-01-29 12:00:00'")
    want = values(bt.incremental_features(stats, mark))
    half = F.pmod(F.xxhash64("block_id", "event_id", "batch_id"), F.lit(2))
    for part in (0, 1):
        bt.store_bucketed(stats.where(half == part), "bucketed_stats", 4, str(tmp_path / "t") if part == 0 else None)
    try:
        for listed in (10_000, 0):
            found = bt.incremental_features_stored(spark, "bucketed_stats", mark, listed=listed)
            assert "Exchange" not in plan(found)
            assert values(found) == want
        newest = sorted({r[0] for r in stats.select("last_updated").collect()})
        one = bt.incremental_features_stored(spark, "bucketed_stats", F.lit(newest[-2]))
        assert one.count() == 1
        assert "SelectedBucketsCount" in plan(one)
    finally:
        spark.sql("DROP TABLE bucketed_stats")
