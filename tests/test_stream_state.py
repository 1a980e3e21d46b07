import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from logloom import adapters as ad
from logloom import catalog
from logloom.operators.features import pivot_counts
from logloom.operators.leaderboard import leaderboard
from logloom.operators.traces import row_windows
from logloom.streaming import details, jobs
from logloom.streaming import row_windows as rw
from logloom.streaming.board import read_board

T4 = ["E5", "E7", "E9", "E26"]


@pytest.fixture
def pieces(spark, small, tmp_path):
    """The events in six files that a stream meets one by one, none of them in order of time."""
    path = str(tmp_path / "pieces")
    events = ad.table(spark, small, "events")
    for i in range(6):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, small, path):
    schema = ad.table(spark, small, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return ad.log_lines(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def test_row_windows_over_out_of_order_batches_and_a_restart(spark, small, pieces, tmp_path, values):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    batch = ad.log_lines(ad.table(spark, small, "events"))
    run = lambda: rw.write_row_windows(
        stream(spark, small, pieces), ad.TEMPLATES, 30, out, checkpoint, late="400 days", slot_seconds=43_200
    ).awaitTermination()
    run()
    assert not os.path.exists(f"{out}/windows")  # nothing has settled yet
    events = ad.table(spark, small, "events")
    for days in (500, 1000):
        # The second time only the marker of the first one settles.
        later = events.limit(1).withColumns({"ts": F.lit(datetime(2024, 1, 1) + timedelta(days=days)), "event_type": F.lit("signup")})
        later.select(*events.columns).withColumn("ts", F.col("ts").cast(events.schema["ts"].dataType)).coalesce(1).write.mode("append").parquet(pieces)
        run()
        if days == 500:
            want = row_windows(batch, ad.TEMPLATES, 30)
            assert values(rw.read_row_windows(spark, out), "window_no", "lines", *T4) == values(want, "window_no", "lines", *T4)
            assert rw.read_row_windows(spark, out, 30).where("lines <> 30").isEmpty()
    total = batch.count()
    assert rw.read_row_windows(spark, out).agg(F.sum("lines")).first()[0] == total + 1
    assert rw._lines_before(spark, out, 10**6) == total + 1


def test_row_windows_go_through_the_state_once_in_blocks(spark, small, pieces, tmp_path, values, monkeypatch):
    out, checkpoint, seen = (str(tmp_path / n) for n in ("out", "cp", "seen"))

    class Noted(rw.HoldRows):
        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            with open(seen, "a") as file:
                file.write(f"{key}\n")
            yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    monkeypatch.setattr(rw, "HoldRows", Noted)
    run = lambda: rw.write_row_windows(
        stream(spark, small, pieces), ad.TEMPLATES, 30, out, checkpoint, late="400 days", slot_seconds=864_000
    ).awaitTermination()
    run()
    events = ad.table(spark, small, "events")
    held = spark.read.format("statestore").option("stateVarName", "blocks").load(checkpoint)
    # Ten-day slots, eight salts and six micro-batches.
    assert held.count() <= 4 * 8 * 6 < events.count()
    later = events.limit(1).withColumns({"ts": F.expr("ts + INTERVAL 800 DAY"), "event_id": F.lit(10**9)})
    later.coalesce(1).write.mode("append").parquet(pieces)
    run()
    want = row_windows(ad.log_lines(events), ad.TEMPLATES, 30)
    assert values(rw.read_row_windows(spark, out), "window_no", "lines", *T4) == values(want, "window_no", "lines", *T4)
    with open(seen) as file:
        keys = file.read().splitlines()
    assert keys and len(keys) == len(set(keys))


@pytest.mark.parametrize(("n", "block"), [(20, 3), (6000, 1)])
def test_held_blocks_keep_microseconds_and_nulls(spark, tmp_path, values, monkeypatch, n, block):
    # The state hands out 500 blocks at a time.
    monkeypatch.setattr(rw, "BLOCK_ROWS", block)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    moment = datetime(2024, 1, 1, 0, 0, 0, 123_456)
    rows = [(i if i else None, moment + timedelta(microseconds=i % 3), "Receiving block x src: a dest: b" if i % 2 else "none") for i in range(n)]
    shape = "line_no long, ts timestamp, line string"
    df = spark.createDataFrame(rows, shape)
    df.coalesce(1).write.parquet(source)
    spark.createDataFrame([(99, moment + timedelta(days=9), "none")], shape).coalesce(1).write.mode("append").parquet(source)
    lines = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    settled = rw.settled_rows(lines, ad.TEMPLATES, "1 day")
    jobs.start(spark, settled.writeStream.format("parquet").option("path", out), checkpoint).awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "blocks").load(checkpoint, batchId=1)
    assert held.count() > n / block
    got = spark.read.schema(settled.schema).parquet(out)
    want = [(t, i, "E5" if "Receiving" in x else None) for i, t, x in rows]
    assert values(got, "ts", "tie", "event_id") == sorted(want, key=repr)


def test_pieces_are_dealt_in_one_pass_to_several_files(spark, tmp_path):
    spark.range(0, 4000, 1, 4).selectExpr("id AS event_id", "id % 500 AS block_id").write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    for key, n in (("event_id", 4), ("block_id", 3)):
        dealt = spark.read.parquet(catalog._pieces(spark, rows, key, n)).withColumn("file", F.input_file_name())
        sizes = [r["count"] for r in dealt.groupBy("file").count().collect()]
        assert len(sizes) == n * catalog.FILES and sum(sizes) == 4000 and max(sizes) < 4000 / n
        assert dealt.select(key, "file").distinct().count() == dealt.select(key).distinct().count()


@pytest.mark.parametrize("bucket", [None, "1 day"])
def test_counts_are_read_from_the_state(spark, small, pieces, tmp_path, values, bucket):
    checkpoint = str(tmp_path / "cp")
    counts = jobs.running_counts(jobs.matched_events(stream(spark, small, pieces), ad.TEMPLATES), T4, bucket=bucket)
    jobs.keep_counts(counts, checkpoint).awaitTermination()
    assert len([n for n in os.listdir(f"{checkpoint}/commits") if n.isdigit()]) >= 6
    want = values(pivot_counts(ad.event_counts(ad.table(spark, small, "events")), T4), "block_id", *T4)
    assert values(jobs.state_counts(spark, checkpoint, counts, T4), "block_id", *T4) == want
    if bucket is None:
        # One row a block, however many micro-batches there were.
        assert spark.read.format("statestore").load(checkpoint).count() == len(want)


def put(spark, path, rows):
    shaped = [(b, 0.5 + s / 100, datetime(2024, 1, 1, 0, 0, t), s, s + 1) for b, s, t in rows]
    df = spark.createDataFrame(shaped, "block_id string, anomaly_score double, detected_at timestamp, E5 long, E7 long")
    df.coalesce(1).write.mode("append").parquet(path)
    return df


@pytest.mark.parametrize("drop", [False, True])
def test_details_expire_by_the_time_of_the_rows(spark, tmp_path, values, drop):
    source, board, checkpoint = (str(tmp_path / n) for n in ("in", "board", "cp"))
    rows = put(spark, source, [("a", 1, 0), ("b", 2, 5)]).union(put(spark, source, [("a", 3, 20), ("c", 4, 1), ("a", 9, 2)]))
    rows = rows.union(put(spark, source, [("d", 5, 29)]))
    raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    details.keep_board(raw, board, checkpoint, seconds=10, late="0 seconds", event_ids=["E5", "E7"], drop=drop).awaitTermination()
    got = values(read_board(spark, board), "block_id", "anomaly_score", "E5")
    live = [("a", 0.53, 3), ("d", 0.55, 5)]
    if not drop:
        live = sorted([*live, ("b", 0.52, None), ("c", 0.54, None)], key=repr)
    assert got == live
    assert [r[0] for r in values(leaderboard(rows, event_ids=["E5", "E7"]), "block_id")] == ["a", "b", "c", "d"]


def test_a_block_keeps_its_newest_row_without_a_table_of_its_own():
    state, timers = {}, []

    class Handle:
        get = staticmethod(lambda: state.get("held"))
        clear = staticmethod(lambda: state.pop("held"))
        getValueState = lambda self, name, schema: self
        deleteTimer = staticmethod(timers.remove)
        registerTimer = staticmethod(timers.append)

        def update(self, value):
            state["held"] = value

    moment = lambda second: datetime(2024, 1, 1, 0, 0, second, 7, tzinfo=timezone.utc)
    columns = ["E5", "anomaly_score", "detected_at"]
    put_in = lambda *rows: list(keep.handleInputRows(("b",), iter([Row("block_id", *columns)("b", *r) for r in rows]), None))
    keep = details.KeepDetails(columns, "E5 long, anomaly_score double", 10, False)
    keep.init(Handle())
    assert [tuple(r) for r in put_in((1, 0.5, moment(3)), (2, 0.9, moment(5)), (3, 0.7, moment(5)))] == [("b", 2, 0.9, moment(5), True)]
    first = list(timers)
    assert put_in((4, 0.8, moment(5)), (5, 1.0, moment(4))) == [] and timers == first
    assert [tuple(r) for r in put_in((6, 0.6, moment(6)))] == [("b", 6, 0.6, moment(6), True)]
    assert timers == [first[0] + 1000]
    assert [tuple(r) for r in keep.handleExpiredTimer(("b",), None, None)] == [("b", 6, 0.6, moment(6), False)] and not state


def test_details_expire_by_the_clock_without_any_row(spark, tmp_path):
    source, board, checkpoint = (str(tmp_path / n) for n in ("in", "board", "cp"))
    schema = put(spark, source, [("a", 1, 0), ("b", 2, 5)]).schema
    raw = spark.readStream.schema(schema).parquet(source)
    query = details.keep_board(raw, board, checkpoint, seconds=8, event_ids=["E5", "E7"], every="1 second")
    try:
        seen = set()
        for _ in range(240):
            now = read_board(spark, board)
            if now is not None:
                rows = now.collect()
                seen.add(tuple(sorted((r.block_id, r.E5) for r in rows)))
                if rows and all(r.E5 is None for r in rows):
                    break
            time.sleep(0.25)
    finally:
        query.stop()
    assert (("a", 1), ("b", 2)) in seen and (("a", None), ("b", None)) in seen
    state = spark.read.format("statestore").option("stateVarName", "detail").load(checkpoint)
    assert state.count() == 0
