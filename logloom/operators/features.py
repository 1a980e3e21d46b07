"""Block x event counts and their reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as sq
from ..functions import text as tx
from ..functions.patterns import Template, matches
from ..sizing import literal_lookup
from ..schemas import DEFAULT_EVENTS, event_order


def block_event_matrix(
    lines: DataFrame, templates: Sequence[Template], mode: str = "literal", line: str = "line"
) -> DataFrame:
    """Wide counts per block, straight from the lines (A1).

    Every line yields one flag per template and the flags are counted in a
    single aggregation, so there is one shuffle, of partial counts, and no
    explode. A block whose lines match nothing keeps its all-zero row. A block
    with a large share of the lines is folded before the shuffle.

    Lines without a block are dropped as one group at the end: a filter on the
    block would be pushed down and search every line for the block twice.
    """
    known = dict(templates)
    ids = event_order(known)
    text = F.col(line)
    flags = lines.select(
        tx.block_id(text).alias("block_id"), *[matches(text, known[e], mode).alias(e) for e in ids]
    )
    counts = flags.groupBy("block_id").agg(
        F.count("block_id").alias("_lines"), *[F.count_if(e).alias(e) for e in ids]
    )
    return counts.where(F.col("_lines") > 0).drop("_lines")


def pivot_counts(
    stats: DataFrame,
    event_ids: Sequence[str] = DEFAULT_EVENTS,
    keys: Sequence[str] = ("block_id",),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Long counts to one row per key (P4); an absent event counts 0.

    Conditional sums in one aggregation, so it also runs on a stream.
    """
    sums = [
        F.expr(f"coalesce(sum(CASE WHEN event_id = {sq.text(e)} THEN cnt END), 0L) AS {sq.name(e)}")
        for e in event_ids
    ]
    return stats.groupBy(*keys).agg(*sums, *extra)


def unpivot_counts(
    wide: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS, keep_zero: bool = False
) -> DataFrame:
    """One row per key and event that occurred (P5)."""
    ids = [c for c in wide.columns if c not in event_ids]
    long = wide.unpivot(ids, [e for e in event_ids if e in wide.columns], "event_id", "cnt")
    return long if keep_zero else long.where(F.col("cnt") > 0)


def zero_missing(df: DataFrame, event_ids: Sequence[str] = DEFAULT_EVENTS) -> DataFrame:
    return df.na.fill(0, [e for e in event_ids if e in df.columns])


def event_array(event_ids: Sequence[str] = DEFAULT_EVENTS, by_count: bool = False) -> Column:
    """``array<struct<event_id, count>>`` of the events that occurred.

    In event order, or by falling count with ties in event order.
    """
    entries = ", ".join(
        f"struct({f'-{sq.name(e)}' if by_count else i} AS rank, {i} AS position, {sq.text(e)} AS event_id, "
        f"{sq.name(e)} AS count)"
        for i, e in enumerate(event_ids)
    )
    present = f"filter(array({entries}), x -> x.count > 0)"
    ordered = f"array_sort({present})" if by_count else present
    return F.expr(f"transform({ordered}, x -> struct(x.event_id AS event_id, x.count AS count))")


def event_text(events: Column, style: str = "pair") -> Column:
    """An event array as text: ``E5:3 E7:1`` or one template line per event."""
    if style == "pair":
        return F.array_join(
            F.transform(events, lambda x: F.concat(x["event_id"], F.lit(":"), x["count"].cast("string"))), " "
        )
    raise ValueError(f"unknown style: {style}")


def event_lines(events: Column, templates: Sequence[Template]) -> Column:
    """``E5: template (出现 3 次)`` per event, one per line; an unlisted event is Unknown."""
    known = dict(templates)
    return F.array_join(
        F.transform(
            events,
            lambda x: F.concat(
                x["event_id"],
                F.lit(": "),
                literal_lookup(x["event_id"], known, "Unknown"),
                F.lit(" (出现 "),
                x["count"].cast("string"),
                F.lit(" 次)"),
            ),
        ),
        "\n",
    )
