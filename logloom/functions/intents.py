"""Rule-based tags of chat messages (X15-X19). All rules are ordered: the first hit wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS

# Command words with tool and parameters, in the order they are tried.
COMMANDS = [
    ("健康度", "get_system_health", ""),
    ("查询健康度", "get_system_health", ""),
    ("系统状态", "get_system_health", ""),
    ("health", "get_system_health", ""),
    ("过去2小时", "get_recent_anomalies", "hours=2"),
    ("查询过去2小时", "get_recent_anomalies", "hours=2"),
    ("过去30分钟", "get_recent_anomalies", "minutes=30"),
    ("查询过去30分钟", "get_recent_anomalies", "minutes=30"),
    ("过去1小时", "get_recent_anomalies", "hours=1"),
    ("top 10", "get_top_anomalies", "limit=10"),
    ("异常列表", "get_top_anomalies", "limit=10"),
    ("top10", "get_top_anomalies", "limit=10"),
    ("异常分布", "get_event_distribution", ""),
    ("分布", "get_event_distribution", ""),
    ("导出数据", "export_anomalies", ""),
    ("导出", "export_anomalies", ""),
    ("帮助", "show_help", ""),
    ("help", "show_help", ""),
    ("?", "show_help", ""),
]
TIME_UNITS = {"小时": "hours", "分钟": "minutes", "秒": "seconds", "天": "days"}

# Routing tags, and the words used when a message carries no tag.
ROUTES = ["diagnosis", "data", "monitor", "general", "ops"]
ROUTE_WORDS = [
    ("diagnosis", ["diagnosis", "诊断", "检测", "异常", "错误", "blk_"]),
    ("data", ["data", "数据", "训练", "预处理", "模型", "批次", "batch"]),
    ("monitor", ["monitor", "监控", "实时", "在线", "启动服务", "停止服务"]),
    ("ops", ["运维", "系统状态", "配置", "清理", "重启服务", "检查状态", "服务管理"]),
]

# Confirmation words, and the operation a request for confirmation names.
CONFIRM_WORDS = ["confirm", "确认", "是", "yes", "y"]
PENDING_WORDS = [
    ("view_config", ["配置"], []),
    ("cleanup_data", ["清理", "Redis"], []),
    ("check_service", ["服务状态", "服务"], []),
    ("restart_service", ["重启"], []),
    ("delete_batch", ["删除"], []),
]
OPERATION_WORDS = [
    ("view_config", ["配置"], ["config"]),
    ("cleanup_data", ["清理"], ["clean"]),
    ("check_service", ["服务状态"], ["service"]),
    ("restart_service", ["重启"], ["restart"]),
    ("delete_batch", ["删除"], ["delete"]),
]

# Error phrases and the kind of error they stand for.
ERROR_PHRASES = [
    ("找不到矩阵文件", "data_not_ready"),
    ("矩阵文件不存在", "data_not_ready"),
    ("找不到模型文件", "model_not_ready"),
    ("模型文件不存在", "model_not_ready"),
    ("训练失败", "model_not_ready"),
    ("模型缺失", "model_not_ready"),
    ("文件缺失", "data_not_ready"),
    ("组件不全", "data_not_ready"),
    ("Connection refused", "connection_failed"),
    ("连接失败", "connection_failed"),
    ("timeout", "timeout"),
    ("超时", "timeout"),
    ("FileNotFoundError", "file_missing"),
]

# Words of an urgent message and patterns of an anxious one.
URGENT_WORDS = ["紧急", "救命", "崩溃了", "坏了", "故障", "不行", "挂了", "死机", "蓝屏", "报错"]
ANXIOUS_PATTERN = r"！{2,}|？{2,}|\?{2,}|操|靠|草|日|(?i:tmd)|(?i:fuck)"


def _first(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(cond, value) for cond, value in rules], otherwise)


def _any_word(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def _strip_lower(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(BLANKS)))


def command(text: Column) -> Column:
    """Tool and parameters a message asks for, as ``struct<tool, params>``."""
    t = _strip_lower(text)

    def call(tool: Column, params: Column) -> Column:
        return F.struct(tool.alias("tool"), params.alias("params"))

    words = [(t.contains(w), call(F.lit(tool), F.lit(params))) for w, tool, params in COMMANDS]
    span = r"过去(\d+)(小时|分钟|秒|天)"
    unit = F.regexp_extract(t, span, 2)
    unit_name = F.coalesce(*[F.when(unit == k, F.lit(v)) for k, v in TIME_UNITS.items()])
    top = r"(top|前)(\d+)"
    patterns = [
        (
            t.rlike(span),
            call(F.lit("get_recent_anomalies"), F.concat(unit_name, F.lit("="), _plain_int(t, span, 1))),
        ),
        (
            t.rlike(top),
            call(F.lit("get_top_anomalies"), F.concat(F.lit("limit="), _plain_int(t, top, 2))),
        ),
    ]
    return _first(words + patterns, call(F.lit("show_help"), F.lit("")))


def _plain_int(text: Column, pattern: str, group: int) -> Column:
    """The captured digits as a number without leading zeros, kept as text."""
    digits = F.regexp_replace(F.regexp_extract(text, pattern, group), "^0+", "")
    return F.when(digits == "", "0").otherwise(digits)


def route(text: Column) -> Column:
    """Routing intent and confidence, as ``struct<intent, confidence>``."""
    tag = F.lower(F.regexp_extract(text, r"(?i:INTENT):\s*([\p{L}\p{N}_]+)", 1))
    given = F.regexp_extract(text, r"CONFIDENCE:\s*([\d.]+)", 1).try_cast("double")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))
    confidence = F.when(given.isNotNull(), clamped).otherwise(F.lit(0.7))
    low = F.lower(text)

    def tagged(intent: Column, value: Column) -> Column:
        return F.struct(intent.alias("intent"), value.alias("confidence"))

    rules = [(tag.isin(ROUTES), tagged(tag, confidence))]
    rules += [(_any_word(low, words), tagged(F.lit(name), F.lit(0.6))) for name, words in ROUTE_WORDS]
    return _first(rules, tagged(F.lit("general"), F.lit(0.5)))


def is_confirmation(text: Column) -> Column:
    return _strip_lower(text).isin(CONFIRM_WORDS)


def asks_confirmation(text: Column) -> Column:
    return text.contains("确认") | F.lower(text).contains("confirm")


def pending_operation(text: Column) -> Column:
    """Operation a request for confirmation is about, empty when it names none."""
    return _operation(text, PENDING_WORDS, "")


def operation(text: Column) -> Column:
    """Operation a user message asks for."""
    return _operation(text, OPERATION_WORDS, "unknown")


def _operation(text: Column, rules: Sequence[tuple[str, list[str], list[str]]], otherwise: str) -> Column:
    low = F.lower(text)
    return _first(
        [(_any_word(text, exact) | _any_word(low, folded), F.lit(name)) for name, exact, folded in rules],
        F.lit(otherwise),
    )


def error_type(text: Column) -> Column:
    """Kind of error a message reports, null for none."""
    low = F.lower(text)
    return _first([(low.contains(p.lower()), F.lit(kind)) for p, kind in ERROR_PHRASES], F.lit(None))


def urgency(text: Column) -> Column:
    """urgent, anxious or normal."""
    anxious = (
        text.rlike(ANXIOUS_PATTERN)
        | (F.regexp_count(text, F.lit("！")) >= 2)
        | (F.regexp_count(text, F.lit("[？?]")) >= 3)
    )
    return (
        F.when(_any_word(F.lower(text), URGENT_WORDS), "urgent").when(anxious, "anxious").otherwise("normal")
    )
