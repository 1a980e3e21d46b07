import pytest
from pyspark.sql import functions as F

from logloom.functions import intents
from logloom.operators import chat
from logloom.plans.conversations import tag_conversations


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, tool, params",
    [
        ("查询健康度", "get_system_health", ""), ("Health?", "get_system_health", ""), ("查询过去2小时", "get_recent_anomalies", "hours=2"),
        ("过去30分钟", "get_recent_anomalies", "minutes=30"), ("过去12小时的异常", "get_recent_anomalies", "hours=12"),
        ("过去007天", "get_recent_anomalies", "days=7"), ("TOP 10", "get_top_anomalies", "limit=10"), ("top100", "get_top_anomalies", "limit=10"),
        ("前25个", "get_top_anomalies", "limit=25"), ("Top 5", "show_help", ""), ("异常分布", "get_event_distribution", ""),
        ("导出", "export_anomalies", ""), ("what?", "show_help", ""), ("", "show_help", ""),
    ],
)
def test_commands(spark, text, tool, params):
    assert tuple(one(spark, intents.command, text)) == (tool, params)


@pytest.mark.parametrize(
    "text, intent, confidence",
    [
        ("INTENT: DIAGNOSIS | CONFIDENCE: 0.95", "diagnosis", 0.95), ("intent: ops", "ops", 0.7), ("INTENT: data CONFIDENCE: 7", "data", 1.0),
        ("INTENT: DATA CONFIDENCE: 1.2.3", "data", 0.7), ("INTENT: XYZ 监控", "monitor", 0.6), ("blk_1 not found", "diagnosis", 0.6),
        ("训练一个模型", "data", 0.6), ("实时", "monitor", 0.6), ("清理", "ops", 0.6), ("现在几点", "general", 0.5), ("INTENT: FOO | CONFIDENCE: 0.9", "general", 0.5),
    ],
)
def test_routes(spark, text, intent, confidence):
    assert tuple(one(spark, intents.route, text)) == (intent, confidence)


@pytest.mark.parametrize("text, want", [("救命", "urgent"), ("快！！", "anxious"), ("啊！好！", "anxious"), ("a?b?c?", "anxious"), ("a？？", "anxious"), ("TMD", "anxious"), ("a?b?", "normal")])
def test_urgency(spark, text, want):
    assert one(spark, intents.urgency, text) == want


@pytest.mark.parametrize("text, want", [("TIMEOUT", "timeout"), ("模型缺失 超时", "model_not_ready"), ("connection refused", "connection_failed"), ("filenotfounderror", "file_missing"), ("ok", None)])
def test_error_types(spark, text, want):
    assert one(spark, intents.error_type, text) == want


@pytest.mark.parametrize("text, want", [(" Yes ", True), ("是", True), ("是的", False), ("y", True)])
def test_confirmation(spark, text, want):
    assert one(spark, intents.is_confirmation, text) is want


@pytest.mark.parametrize("text, want", [("show Config", "view_config"), ("clean", "cleanup_data"), ("services", "check_service"), ("删除", "delete_batch"), ("hi", "unknown")])
def test_operations(spark, text, want):
    assert one(spark, intents.operation, text) == want


MESSAGES = [
    (1, 0, "user", "删除批次 7"), (1, 1, "assistant", "删除需要确认"), (1, 2, "user", "确认"),
    (2, 0, "user", "confirm"),
    (3, 0, "assistant", "请确认配置"), (3, 1, "assistant", "confirm?"), (3, 2, "user", "yes"),
    (4, 0, "assistant", "hello"),
    (5, 0, "user", "检测异常"), (5, 1, "assistant", "timeout"), *[(5, i, "assistant", "fine") for i in range(2, 11)],
    (6, 0, "assistant", "timeout"), *[(6, i, "assistant", "fine") for i in range(1, 11)],
    (7, 0, "human", "top3"), (7, 1, "ai", "连接失败"), (7, 2, "ai", "超时"),
]


def test_conversation_tags(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in tag_conversations(df).collect()}
    assert {k: (r.intent, r.confidence, r.pending, r.error_type) for k, r in got.items()} == {
        1: ("ops", 1.0, "delete_batch", ""),
        2: ("general", 0.8, "", ""),
        3: ("general", 0.8, "", ""),
        4: ("general", 0.5, "", ""),
        5: ("diagnosis", 0.6, "", "timeout"),
        6: ("general", 0.5, "", ""),
        7: ("general", 0.5, "", "timeout"),
    }
    assert (got[7].tool, got[7].params, got[4].last_turn) == ("get_top_anomalies", "limit=3", None)


def test_newest_messages(spark, values):
    df = spark.createDataFrame(MESSAGES, "conv_id int, turn int, role string, text string")
    assert values(chat.newest(df.where("conv_id = 5"), 2), "turn") == [(10,), (9,)]
    assert dict(values(chat.last_user_message(df), "conv_id", "text"))[7] == "top3"
