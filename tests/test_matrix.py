import pytest

from logloom.operators import features as ft
from logloom.operators import labels as lb
from logloom.plans.matrix import build_matrix, build_training_set, compare_matrices, ingest_messages
from logloom.sources.logs import as_lines, decode_batched, decode_wide

TEMPLATES = [("E10", "ten [*]"), ("E7", "seven [*]"), ("E5", "five"), ("E2", "five six")]


def matrix_lines(spark):
    texts = ["seven blk_1", "ten blk_1 five", "nothing blk_2", "five six blk_-3", "  ", "five no block", "ten blk_1"]
    return as_lines(spark.createDataFrame([(t,) for t in texts], "value string"))


def test_matrix_keeps_zero_rows_orders_events_and_counts_every_match(spark):
    labels = spark.createDataFrame([("blk_1", "Anomaly"), ("blk_-3", "Normal"), ("blk_1", "Normal"), ("blk_9", "Anomaly")], "block_id string, label string")
    df = build_matrix(matrix_lines(spark), TEMPLATES, labels)
    assert df.columns == ["block_id", "label", "type", "E2", "E5", "E7", "E10"]
    assert [tuple(r) for r in df.collect()] == [
        ("blk_-3", "Success", None, 1, 1, 0, 0),
        ("blk_1", "Fail", 7, 0, 1, 1, 2),
        ("blk_2", "Success", None, 0, 0, 0, 0),
    ]


def test_matrix_without_labels_is_all_success(spark):
    assert {r.label for r in build_matrix(matrix_lines(spark), TEMPLATES).collect()} == {"Success"}


def test_type_belongs_to_its_own_block(spark):
    lines = as_lines(spark.createDataFrame([("five blk_1",), ("seven blk_2",)], "value string"))
    labels = spark.createDataFrame([("blk_1", "Anomaly"), ("blk_2", "Anomaly")], "block_id string, label string")
    assert [r.type for r in build_matrix(lines, TEMPLATES, labels).collect()] == [5, 7]


def test_pivot_and_unpivot_are_inverse(spark, values):
    rows = [("a", "E1", 2), ("a", "E3", 1), ("a", "E1", 3), ("b", "E9", 4)]
    long = spark.createDataFrame(rows, "block_id string, event_id string, cnt long")
    wide = ft.pivot_counts(long, ["E1", "E2", "E3"])
    assert values(wide) == [("a", 5, 0, 1), ("b", 0, 0, 0)]
    assert values(ft.unpivot_counts(wide, ["E1", "E2", "E3"])) == [("a", "E1", 5), ("a", "E3", 1)]
    assert ft.unpivot_counts(wide, ["E1", "E2", "E3"], keep_zero=True).count() == 6


def test_event_arrays_and_texts(spark):
    df = spark.createDataFrame([(1, 3, 0, 3)], "E1 long, E2 long, E3 long, E4 long")
    ids = df.columns
    row = df.select(
        ft.event_array(ids).alias("a"), ft.event_array(ids, by_count=True).alias("b"),
        ft.event_text(ft.event_array(ids)).alias("t"), ft.event_lines(ft.event_array(ids), [("E1", "one"), ("E2", "two")]).alias("l"),
    ).first()
    assert [tuple(x) for x in row.a] == [("E1", 1), ("E2", 3), ("E4", 3)]
    assert [tuple(x) for x in row.b] == [("E2", 3), ("E4", 3), ("E1", 1)]
    assert row.t == "E1:1 E2:3 E4:3"
    assert row.l == "E1: one (出现 1 次)\nE2: two (出现 3 次)\nE4: Unknown (出现 3 次)"


def test_zero_missing(spark):
    df = spark.createDataFrame([(None, 1)], "E1 long, x long")
    assert ft.zero_missing(df, ["E1", "E2"]).first().E1 == 0


def test_training_set_encodes_labels(spark, values):
    features = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "block_id string, E1 long")
    labels = spark.createDataFrame([("a", "Success"), ("b", "Fail"), ("c", None)], "block_id string, label string")
    df = build_training_set(features, labels, ["E1"])
    assert df.columns == ["block_id", "label", "target", "E1"]
    assert values(df) == [("a", "Success", 0, 1), ("b", "Fail", 1, 2), ("c", None, None, 3)]
    assert dict(values(lb.class_balance(df))) == {0: 1, 1: 1, None: 1}


def test_compare_counts_nulls_as_different(spark, values):
    mine = spark.createDataFrame([("a", 1, 1), ("b", 2, None), ("c", 0, 0)], "block_id string, E1 long, E2 long")
    other = spark.createDataFrame([("a", 1, 2), ("b", 3, None), ("z", 0, 0)], "block_id string, E1 long, E2 long")
    assert values(compare_matrices(mine, other, ["E1", "E2"])) == [(2, "E1", 1), (2, "E2", 2), (2, "total", 3)]


def test_messages(spark, values):
    raw = spark.createDataFrame(
        [("7\t081109 203520 1 INFO: five blk_1",), ("7\t081109 203522 1 INFO: five blk_1\tx",), ("8\t  ",), ("no tab",), ("9\tfive",)],
        "value string",
    )
    decoded = decode_batched(raw)
    assert [r[0] for r in values(decoded)] == ["7", "7", "9"]
    rows = ingest_messages(decoded, TEMPLATES).collect()
    assert [(r.batch_id, r.block_id, r.event_id, r.cnt, str(r.last_updated)) for r in rows] == [
        ("7", "blk_1", "E5", 2, "2008-11-09 20:35:22")
    ]


def test_wide_messages_leave_absent_events_empty(spark):
    raw = spark.createDataFrame([('{"batch_id":"1","block_id":"b","E2":4}',)], "value string")
    row = decode_wide(raw, event_ids=["E1", "E2"]).first()
    assert (row.batch_id, row.block_id, row.E1, row.E2) == ("1", "b", None, 4)


def test_one_hot_block_needs_one_shuffle_of_partial_counts(spark):
    text = build_matrix(matrix_lines(spark), TEMPLATES, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text and "Generate" not in text and "rangepartitioning" not in text


@pytest.mark.parametrize("mode", ["literal", "raw"])
def test_modes_agree_without_special_characters(spark, values, mode):
    assert values(build_matrix(matrix_lines(spark), [("E7", "seven [*]")], mode=mode)) == [
        ("blk_-3", "Success", None, 0), ("blk_1", "Success", None, 1), ("blk_2", "Success", None, 0),
    ]


def test_labels_default(spark, values):
    features = spark.createDataFrame([("a", 1)], "block_id string, E5 long")
    labels = spark.createDataFrame([("a", None)], "block_id string, label string")
    assert values(lb.with_default_labels(features, labels, ["E5"])) == [("a", "Success", None, 1)]
