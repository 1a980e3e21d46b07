"""Line classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.patterns import Template, first_match
from ..functions.tiers import is_anomaly_event
from .template_index import first_matches, indexed_matches

UNKNOWN_ERROR = "E_UNKNOWN_ERR"


def classify_lines(
    lines: DataFrame,
    templates: Sequence[Template] | DataFrame,
    keyword_fallback: bool = True,
    line: str = "line",
    key: str | None = None,
) -> DataFrame:
    """Add ``match_type``, ``event_id``, ``type`` and ``block_id`` to every line.

    With a list of templates one projection without a shuffle, which works on a
    stream as well. A table of templates (position, event_id, template) of any
    size goes through an index; the lines then need a unique ``key``, by which
    their matches are joined. Only anomalous lines name their block.
    """
    text = F.col(line)
    if isinstance(templates, DataFrame):
        if key is None:
            raise ValueError("a table of templates needs a unique key of the lines")
        found = lines.join(first_matches(lines, templates, key, line), key, "left")
    else:
        found = lines.withColumn("event_id", first_match(text, templates))
    word = tx.has_error_word(text) if keyword_fallback else F.lit(False)
    kind = F.when(F.col("event_id").isNotNull(), "template").when(word, "keyword_fallback").otherwise("unknown")
    typed = found.withColumn("match_type", kind)
    event = F.when(F.col("match_type") == "keyword_fallback", UNKNOWN_ERROR).otherwise(F.col("event_id"))
    anomalous = (F.col("match_type") == "keyword_fallback") | is_anomaly_event(F.col("event_id"))
    typed = typed.withColumn(
        "type",
        F.when(F.col("match_type") == "unknown", "unknown")
        .when(anomalous, "anomaly")
        .otherwise("normal"),
    ).withColumn("event_id", event)
    return typed.withColumn("block_id", F.when(F.col("type") == "anomaly", tx.block_id(text, lenient=True)))


def match_counters(classified: DataFrame) -> DataFrame:
    """One row of counters over classified lines; aggregated map-side."""
    kind, group = F.col("match_type"), F.col("type")
    return classified.agg(
        F.count("*").alias("total"),
        F.count_if(kind == "template").alias("template"),
        F.count_if(kind == "keyword_fallback").alias("keyword_fallback"),
        F.count_if(group == "anomaly").alias("anomaly"),
        F.count_if(group == "normal").alias("normal"),
        F.count_if(group == "unknown").alias("unknown"),
        F.count_if(kind != "unknown").alias("matched"),
    )


def unmatched_lines(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("match_type") != "template")


def anchor_word(template: str) -> str | None:
    """The longest word of a template that any matching line must hold as a whole word.

    Only words with a non-word character on both sides inside the fixed text
    qualify: at an edge the line may continue the word.
    """
    import re

    inner = [w for part in template.split("[*]") for w in re.findall(r"(?<=[^A-Za-z0-9_])[A-Za-z0-9_]+(?=[^A-Za-z0-9_])", part)]
    return max(inner, key=len) if inner else None


def match_by_anchor(lines: DataFrame, templates: DataFrame, key: str, line: str = "line") -> DataFrame:
    """All matches against a table of templates (event_id, template): ``key, event_id``.

    By the index of ``indexed_matches``, which picks the rarest term itself.
    """
    placed = templates.select(F.monotonically_increasing_id().alias("position"), "event_id", "template")
    return indexed_matches(lines, placed, key, line).select(key, "event_id")
