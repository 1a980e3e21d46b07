import pytest
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.functions import tiers


def apply(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.orderBy("i").select(fn(F.col("t")).alias("v")).collect()]


def test_block_ids(spark):
    texts = ["a blk_-123 b blk_5", "x blk-9", "blk77", "none", "blk_", None]
    assert apply(spark, tx.block_id, texts) == ["blk_-123", None, None, None, None, None]
    lenient = apply(spark, lambda c: tx.block_id(c, lenient=True), texts)
    assert lenient == ["blk_-123", "blk-9", "blk77", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize(
    "text, seconds",
    [("2h", 7200), ("30m", 1800), ("90s", 90), ("1d", 86400), ("1h30m", 5400), ("2h30m15s", 9015), (" 1H ", 3600),
     ("5", 18000), ("", 3600), ("0", 3600), ("0s", 3600), ("abc", 3600), ("12abc", 43200), ("-5", -18000), ("1h x 1h", 7200)],
)
def test_durations(spark, text, seconds):
    assert apply(spark, tx.duration_seconds, [text]) == [seconds]


def test_clean_line_strips_and_drops_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"  a\xff b\t\r"),)], "b binary")
    assert df.select(tx.clean_line(F.col("b").cast("string")).alias("v")).first().v == "a b"


def test_mask_variables(spark):
    line = "081109 203520 145 INFO n: Received block blk_-12 of size 9 from /10.1.2.3:50010 on 2024-01-02"
    assert apply(spark, tx.mask_variables, [line]) == [
        "<*> <*> INFO n: Received block <*> of size <*> from <*> on <*>"
    ]


def test_words_and_truncation(spark):
    assert apply(spark, tx.keywords, ["E1 错误 a_b-c?"]) == [["E1", "a_b", "c"]]
    assert apply(spark, tx.truncate, ["x" * 300]) == ["x" * 200]


def test_tiers_and_ratios(spark):
    row = spark.range(1).select(
        tiers.severity(F.lit(0.8)).alias("a"), tiers.severity(F.lit(0.81)).alias("b"), tiers.report_tier(F.lit(0.6)).alias("c"),
        tiers.batch_risk(F.lit(50)).alias("d"), tiers.batch_risk(F.lit(51)).alias("e"),
        tiers.health_percent(F.lit(3), F.lit(0)).alias("f"), tiers.health_percent(F.lit(1), F.lit(3)).alias("g"),
        tiers.health_tier(F.lit(79.9)).alias("h"), tiers.health_tier(F.lit(95.0)).alias("i"),
        tiers.ratio(F.lit(1), F.lit(0)).alias("j"), tiers.ratio(F.lit(1), F.lit(3)).alias("k"),
        tiers.batch_time(F.lit("1704067200")).alias("l"), tiers.batch_time(F.lit("online_1")).alias("m"),
        tiers.label_target(F.lit("other")).alias("n"),
    ).first()
    assert tuple(row) == (
        "medium", "high", "medium", "medium", "high", 100.0, 66.7, "attention", "excellent", 0.0, 0.3333,
        "2024-01-01 00:00", "unknown", None,
    )


def test_anomaly_type_priority(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 1, 0), (1, 1, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0)], "E4 int, E5 int, E21 int, E7 int")
    got = [r.t for r in df.select(tiers.anomaly_type(df.columns).alias("t")).collect()]
    assert got == [7, 21, 5, 4, 0]


def test_mined_templates_match_their_lines(spark, values):
    from logloom.functions.patterns import first_match
    from logloom.operators.mining import mine_templates

    lines = [f"user u{i} logged in" for i in range(30)] + [f"disk {w}  is full" for w in ["alpha", "beta", "gamma"] * 4] + ["odd one out", "", "seen"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(99, None)], "line_no long, line string")
    found = values(mine_templates(df, share=0.5, least=3), "position", "event_id", "template", "lines")
    assert found == [(1, "M1", "user [*] logged in", 30), (2, "M2", "disk [*]  is full", 12)]
    fixed = values(mine_templates(df, share=0.2, least=3), "template", "lines")
    assert ("disk alpha  is full", 4) in fixed
    pairs = [(e, t) for _, e, t, _ in found]
    events = df.select(first_match(F.col("line"), pairs).alias("e")).where("e IS NOT NULL").groupBy("e").count()
    assert values(events) == [("M1", 30), ("M2", 12)]
    assert mine_templates(df.where("false")).count() == 0
