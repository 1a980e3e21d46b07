"""Templates mined from the lines themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import WILDCARD
from ..session import written_once


def _words(line: Column) -> Column:
    return F.split(line, " ")


def mine_templates(
    lines: DataFrame, line: str = "line", share: float = 0.05, least: int = 2, digits_vary: bool = True
) -> DataFrame:
    """``position, event_id, template, lines``: what frequent lines have in common, most frequent first.

    A word is fixed at its place if at least ``share`` of the lines with as many
    words have it there, and ``least`` lines in all; every other word becomes a
    wildcard, and so does one with a digit unless ``digits_vary`` is off.
    Templates of fewer than ``least`` lines are left out. Words are parted by
    single blanks, so that a template matches its lines to the letter.

    Two aggregations, both summed before the shuffle: words by (number of words,
    place), of which at most ``1 / share`` each remain, then templates.
    """
    split = lines.where(F.col(line).isNotNull()).select(_words(F.col(line)).alias("words")).withColumn("size", F.size("words"))
    sizes = split.groupBy("size").agg(F.count("*").alias("all"))
    places = split.select("size", F.posexplode("words").alias("place", "word"))
    if digits_vary:
        places = places.where(~F.col("word").rlike("[0-9]"))
    counts = places.groupBy("size", "place", "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    fixed = counts.join(sizes, "size").where(F.col("n") >= share * F.col("all"))
    held = fixed.groupBy("size").agg(F.collect_set(F.concat("place", F.lit(":"), "word")).alias("fixed"))
    marked = split.join(written_once(held, "words"), "size", "left")
    kept = F.transform(
        "words",
        lambda w, i: F.when(F.array_contains("fixed", F.concat(i.cast("string"), F.lit(":"), w)), w).otherwise(F.lit(WILDCARD)),
    )
    found = marked.groupBy(F.array_join(kept, " ").alias("template")).agg(F.count("*").alias("lines")).where(F.col("lines") >= least)
    # Few rows: each stands for at least ``least`` lines, and frequent words are few.
    order = Window.orderBy(F.desc("lines"), "template")
    placed = found.withColumn("position", F.row_number().over(order).cast("bigint"))
    return placed.select("position", F.concat(F.lit("M"), "position").alias("event_id"), "template", "lines")
