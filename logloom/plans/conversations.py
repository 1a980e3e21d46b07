"""All tags of a chat table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intents
from ..operators.chat import recent_error, routed


def tag_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation: route, confirmation, command, urgency and recent error."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tags = routed(messages).withColumn("_command", intents.command(text))
    return tags.join(recent_error(messages), "conv_id", "left").select(
        "conv_id",
        F.col("turn").alias("last_turn"),
        "is_confirmation",
        "pending",
        "intent",
        "confidence",
        F.col("_command.tool").alias("tool"),
        F.col("_command.params").alias("params"),
        intents.operation(text).alias("operation"),
        intents.urgency(text).alias("urgency"),
        F.coalesce("error_type", F.lit("")).alias("error_type"),
    )
