"""Message tags per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents

USER_ROLES = ["user", "human"]
ASSISTANT_ROLES = ["assistant", "ai"]


def newest(messages: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` newest messages of every conversation.

    The rank limit also runs before the shuffle, so a conversation with most of
    the messages sends ``n`` rows per input partition.
    """
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def last_user_message(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, text`` of the newest user message."""
    return newest(messages.where(F.col("role").isin(USER_ROLES))).select("conv_id", "turn", "text")


def pending_operations(messages: DataFrame) -> DataFrame:
    """Operation named by the newest assistant message that asks for confirmation."""
    asking = messages.where(F.col("role").isin(ASSISTANT_ROLES) & intents.asks_confirmation(F.col("text")))
    return newest(asking).select("conv_id", intents.pending_operation(F.col("text")).alias("pending"))


def recent_error(messages: DataFrame, n: int = 10) -> DataFrame:
    """Error kind of the newest message, among the last ``n``, that reports one."""
    tagged = newest(messages, n).withColumn("error_type", intents.error_type(F.col("text")))
    hit = F.when(F.col("error_type").isNotNull(), F.col("turn"))
    return tagged.groupBy("conv_id").agg(
        F.coalesce(F.max_by("error_type", hit), F.lit("")).alias("error_type")
    )


def routed(messages: DataFrame) -> DataFrame:
    """Route of every conversation by its last user message and any open confirmation.

    Both are found in one aggregation, folded before the shuffle.
    """
    role, turn, body = F.col("role"), F.col("turn"), F.col("text")
    spoken = F.when(role.isin(USER_ROLES), turn)
    asked = F.when(role.isin(ASSISTANT_ROLES) & intents.asks_confirmation(body), turn)
    last = messages.groupBy("conv_id").agg(
        F.max(spoken).alias("turn"),
        F.max_by("text", spoken).alias("text"),
        F.coalesce(F.max_by(intents.pending_operation(body), asked), F.lit("")).alias("pending"),
    )
    confirmed = F.coalesce(intents.is_confirmation(body), F.lit(False))

    def verdict(intent: str, confidence: float):
        return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"))

    decision = (
        F.when(F.coalesce(body, F.lit("")) == "", verdict("general", 0.5))
        .when(confirmed & (F.col("pending") != ""), verdict("ops", 1.0))
        .when(confirmed, verdict("general", 0.8))
        .otherwise(intents.route(body))
    )
    return last.withColumn("is_confirmation", confirmed).withColumn("_route", decision).select(
        "conv_id", "turn", "text", "is_confirmation", "pending", "_route.intent", "_route.confidence"
    )
