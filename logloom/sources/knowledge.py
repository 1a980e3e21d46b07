"""Knowledge files and the error-code table inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``source``, ``text``."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


# The layout of the error-code text.
SECTION = r"(?s)### (E\d+): ([^\n]*)\n\*\*严重程度\*\*: ([^\n]*)"
TABLE_ROW = r"(?m)^\| (E\d+) \| ([^|\n]*) \| ([^|\n]*) \| ([^|\n]*) \|"


def error_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """``event_id, title, severity`` of every code section of the texts."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(SECTION), F.lit(0)))
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, found.alias("hit")).select(
        *others,
        *[F.trim(F.regexp_extract("hit", SECTION, i)).alias(n) for i, n in ((1, "event_id"), (2, "title"), (3, "severity"))],
    )


def error_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``event_id, type, severity, action`` of every row of the quick tables."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(TABLE_ROW), F.lit(0)))
    others = [c for c in docs.columns if c != text]
    names = ((1, "event_id"), (2, "type"), (3, "severity"), (4, "action"))
    return docs.select(*others, found.alias("hit")).select(
        *others, *[F.trim(F.regexp_extract("hit", TABLE_ROW, i)).alias(n) for i, n in names]
    )
