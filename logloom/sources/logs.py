"""Log lines, batched messages and template files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import computed_once
from ..functions.patterns import Template
from ..functions.text import clean_line
from ..schemas import DEFAULT_EVENTS, TEMPLATES, wide_record
from ..sizing import rows_if_small
from .numbering import numbered

#: Templates that a plan holds as literals.
MAX_TEMPLATES = 5_000


def as_lines(raw: DataFrame, column: str = "value") -> DataFrame:
    """Stripped, non-blank lines of a text source (batch or stream)."""
    others = [c for c in raw.columns if c != column]
    return raw.select(*others, clean_line(F.col(column)).alias("line")).where(F.length("line") > 0)


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return as_lines(spark.read.text(path))


def decode_batched(raw: DataFrame, column: str = "value") -> DataFrame:
    """``batch_id TAB line`` messages; only the first tab separates."""
    parts = computed_once(raw, [], parts=F.split(F.col(column).cast("string"), "\t", 2))
    batch, line = F.col("parts").getItem(0), F.try_element_at("parts", F.lit(2))
    return computed_once(parts, [], batch_id=batch, line=clean_line(line)).where(F.length("line") > 0)


def encode_batched(batch: Column, line: Column) -> Column:
    return F.concat(batch, F.lit("\t"), line)


def decode_wide(raw: DataFrame, column: str = "value", event_ids: Sequence[str] = DEFAULT_EVENTS) -> DataFrame:
    """JSON block records; events a record does not carry stay null."""
    record = F.from_json(F.col(column).cast("string"), wide_record(event_ids))
    return raw.select(record.alias("r")).select("r.*")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """``position, event_id, template``: any number of templates, numbered in file order."""
    rows = spark.read.csv(path, schema=TEMPLATES, header=True, quote='"', escape='"')
    return numbered(rows, "position").select(
        "position", F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("template")
    )


def load_templates(spark: SparkSession, path: str, limit: int = MAX_TEMPLATES) -> list[Template] | DataFrame:
    """Templates in file order: a list of at most ``limit`` that goes into the plan, else the table of ``read_templates``.

    ``classify_lines``, ``event_counts`` and ``build_matrix`` take either.
    """
    table = read_templates(spark, path)
    rows = rows_if_small(table, limit)
    return table if rows is None else [(r.event_id, r.template) for r in sorted(rows, key=lambda r: r.position)]


def kafka_options(
    servers: str,
    topic: str,
    starting: str = "earliest",
    max_per_trigger: int | None = None,
    group: str | None = None,
) -> dict[str, str]:
    """Options of a Kafka source; the checkpoint keeps the offsets after the first start."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if group:
        options["kafka.group.id"] = group
    return options


def read_kafka(spark: SparkSession, options: dict[str, str], stream: bool = True) -> DataFrame:
    """Message values as text. Needs the Kafka connector on the session's classpath."""
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))
