import os
import shutil
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom import adapters as ad
from logloom.operators.classify import classify_lines, match_counters
from logloom.operators.features import pivot_counts
from logloom.operators.traces import time_windows
from logloom.streaming import jobs
from logloom.streaming.board import read_board

T4 = ["E5", "E7", "E9", "E26"]


@pytest.fixture
def pieces(spark, small, tmp_path):
    """The event table in four files, to be read one file per micro-batch."""
    path = str(tmp_path / "in")
    ad.table(spark, small, "events").repartitionByRange(4, "event_id").write.parquet(path)
    return path


def stream(spark, small, path):
    schema = ad.table(spark, small, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return ad.log_lines(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def test_classified_stream_equals_batch_and_reports_counters(spark, small, pieces, tmp_path):
    log = jobs.ProgressLog()
    spark.streams.addListener(log)
    out = str(tmp_path / "out")
    try:
        jobs.classify_stream(stream(spark, small, pieces), ad.TEMPLATES, out, str(tmp_path / "cp")).awaitTermination()
        for _ in range(50):
            if sum(e["counters"].get("counters", {}).get("total", 0) for e in log.entries) >= 1000:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    want = match_counters(classify_lines(ad.log_lines(ad.table(spark, small, "events")), ad.TEMPLATES)).first()
    assert match_counters(spark.read.parquet(out)).first() == want
    assert sum(e["counters"]["counters"]["anomaly"] for e in log.entries if e["counters"]) == want.anomaly
    assert os.path.isdir(f"{out}/match_type=keyword_fallback")


@pytest.mark.parametrize("bucket", [None, "1 day"])
def test_running_counts_equal_batch_and_survive_a_restart(spark, small, pieces, tmp_path, values, bucket):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    held = str(tmp_path / "later")
    os.makedirs(held)
    names = sorted(n for n in os.listdir(pieces) if n.endswith(".parquet"))
    for n in names[2:]:
        shutil.copy(f"{pieces}/{n}", held)
        os.remove(f"{pieces}/{n}")

    def run():
        counts = jobs.running_counts(jobs.matched_events(stream(spark, small, pieces), ad.TEMPLATES), T4, bucket=bucket)
        jobs.write_updates(counts, out, checkpoint).awaitTermination()

    run()
    for n in names[2:]:
        shutil.copy(f"{held}/{n}", pieces)
    run()
    want = values(pivot_counts(ad.event_counts(ad.table(spark, small, "events")), T4), "block_id", *T4)
    assert values(jobs.latest_counts(spark, out, T4), "block_id", *T4) == want


def test_scored_stream_fills_table_and_board(spark, small, pieces, tmp_path, values):
    paths = [str(tmp_path / n) for n in ("anomalies", "board", "cp")]
    counts = jobs.running_counts(jobs.matched_events(stream(spark, small, pieces), ad.TEMPLATES))
    scorer = lambda f: f.withColumn("anomaly_score", ad.score_expression())
    jobs.score_stream(counts, scorer, *paths, threshold=0.2).awaitTermination()
    rows = spark.read.parquet(paths[0])
    assert rows.select("micro_batch").distinct().count() > 1
    board = read_board(spark, paths[1])
    # Every board row is the newest stored row of its block.
    newest = rows.groupBy("block_id").agg(F.max_by("anomaly_score", "micro_batch").alias("s"))
    joined = board.join(newest, "block_id")
    assert joined.count() == board.count() == 10 and joined.where("s <> anomaly_score").count() == 0


def test_window_counts_equal_batch(spark, small, pieces, tmp_path, values):
    out = str(tmp_path / "out")
    lines = stream(spark, small, pieces)
    jobs.write_updates(jobs.window_counts(lines, ad.TEMPLATES), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out).groupBy("window_start").agg(*[F.max(e).alias(e) for e in T4])
    batch = ad.log_lines(ad.table(spark, small, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    assert values(got) == values(time_windows(batch, ad.TEMPLATES))
    sliding = jobs.window_counts(lines, ad.TEMPLATES, length="1 hour", slide="30 minutes")
    assert sliding.isStreaming and "window_end" in sliding.columns


def test_labelled_windows(spark, values):
    rows = [(datetime(2024, 1, 1, 0, 0, 5), "five blk_1"), (datetime(2024, 1, 1, 0, 1, 5), "five blk_2")]
    lines = spark.createDataFrame(rows, "ts timestamp_ntz, line string")
    labels = spark.createDataFrame([("blk_2", "Anomaly"), ("blk_1", "Normal")], "block_id string, label string")
    windows = time_windows(lines, [("E5", "five")])
    assert [r[1] for r in values(jobs.label_windows(windows, lines, labels), "window_start", "label")] == [0, 1]


def test_dropped_files_are_read_once_and_archived(spark, tmp_path):
    drop, archive, out = (str(tmp_path / n) for n in ("drop", "done", "out"))
    os.makedirs(drop)

    def put(name, text):
        with open(f"{drop}/{name}", "w") as f:
            f.write(text)

    def run():
        lines = jobs.read_log_drop(spark, drop, archive=archive)
        writer = lines.writeStream.format("parquet").option("path", out)
        jobs.start(spark, writer, str(tmp_path / "cp")).awaitTermination()

    put("a.log", " one \n\n two\n")
    put("b.txt", "three\n")
    put("c.csv", "no\n")
    run()
    put("d.log", "four\n")
    run()
    put("e.log", "five\n")
    run()
    got = spark.read.parquet(out)
    assert sorted(r.line for r in got.collect()) == ["five", "four", "one", "three", "two"]
    assert got.where(~F.col("batch_id").rlike("^online_[0-9]+$")).count() == 0
    assert "a.log" not in os.listdir(drop) and "c.csv" in os.listdir(drop)


def test_state_store_setting_is_restored(spark):
    before = spark.conf.get(jobs.STORE_KEY, None)
    with jobs.disk_state(spark):
        assert spark.conf.get(jobs.STORE_KEY) == jobs.ROCKSDB
    assert spark.conf.get(jobs.STORE_KEY, None) == before


def test_very_late_rows_still_count(spark, tmp_path, values):
    """Three micro-batches, the last of them a month older than the first."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    template = ad.TEMPLATES[0]
    line = template[1].replace("[*]", "blk_7")
    for day in (30, 29, 1):
        row = [(datetime(2024, 1, day, 12), line)]
        spark.createDataFrame(row, "ts timestamp, line string").coalesce(1).write.mode("append").parquet(source)
        lines = spark.readStream.schema("ts timestamp, line string").parquet(source)
        jobs.write_updates(jobs.window_counts(lines, [template], length="1 hour"), out, checkpoint).awaitTermination()
    got = spark.read.parquet(out).groupBy("window_start").agg(F.max(template[0]).alias("n"))
    assert sorted((r.window_start.day, r.n) for r in got.collect()) == [(1, 1), (29, 1), (30, 1)]
