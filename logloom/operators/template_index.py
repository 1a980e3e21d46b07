"""Matching against template tables of any size, by way of an index of their terms.

A template that occurs in a line shares every one of its terms with it. The
index holds one term of each template, the one that fewest lines have, so a
line is compared only with the templates whose rarest term it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.patterns import WILDCARD
from ..session import written_once
from ..sizing import is_small

#: Index rows, and terms, of a kind that are copied to every task.
COPIED = 50_000
#: Parts of a template that are looked for by compiled code; further ones by a fold.
COMPILED = 4

# How the terms of a text are found, by kind: whole words, three code points in
# a row, single code points, and the empty term that every line has. Inside a
# template only words with a non-word character on both sides are whole for sure.
_IN_LINE = {"w": r"[A-Za-z0-9_]+", "g": r"(?s)(?=(...))", "c": r"(?s)."}
_IN_TEMPLATE = {**_IN_LINE, "w": r"(?<=[^A-Za-z0-9_])[A-Za-z0-9_]+(?=[^A-Za-z0-9_])"}


def _found(text: Column, kind: str, patterns: dict[str, str]) -> Column:
    return F.regexp_extract_all(text, F.lit(patterns[kind]), F.lit(1 if kind == "g" else 0))


def template_parts(template: Column) -> Column:
    """The fixed texts between the wildcards, without empty ones."""
    return F.filter(F.split(template, WILDCARD.replace("[", r"\[").replace("*", r"\*").replace("]", r"\]")), lambda p: p != "")


def holds_parts(line: Column, parts: Column) -> Column:
    """True when the parts occur in the line one after the other; leftmost places decide, without a pattern."""

    def after(place: Column, part: Column) -> Column:
        at = F.call_function("locate", part, line, place)
        return F.when(place == 0, 0).when(at == 0, 0).otherwise(at + F.length(part))

    return F.aggregate(parts, F.lit(1), after) > 0


def _holds_first_parts(line: Column, parts: Column, n: int) -> Column:
    """``holds_parts`` of the first ``n`` parts, in functions that Spark compiles; a part that is not there is found."""
    own = [F.get(parts, F.lit(i)) for i in range(n)]
    # Most templates fail by a part that the line does not hold at all, which costs least to see.
    tests, place = [F.contains(line, part) for part in own], F.lit(1)
    for before, part in zip(own, own[1:]):
        place = F.call_function("locate", before, line, place) + F.length(before)
        tests.append(F.contains(F.substring(line, place, F.lit(2**31 - 1)), part))
    return reduce(Column.__and__, [F.coalesce(t, F.lit(True)) for t in tests], F.lit(True))


def template_terms(templates: DataFrame) -> DataFrame:
    """``position, event_id, parts, terms``: words if a template has any, else the next kind that it has."""
    parts = templates.where(F.col("template").isNotNull()).select("position", "event_id", template_parts(F.col("template")).alias("parts"))
    terms = F.array(F.lit("e"))
    for kind in ("c", "g", "w"):
        terms = _or_else(kind, terms)
    return parts.withColumn("terms", F.array_distinct(terms))


def _or_else(kind: str, terms: Column) -> Column:
    own = F.flatten(F.transform("parts", lambda p: F.transform(_found(p, kind, _IN_TEMPLATE), lambda x: F.concat(F.lit(kind), x))))
    return F.when(F.size(own) > 0, own).otherwise(terms)


def line_terms(lines: DataFrame, kind: str, line: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """``<keep>, term``: the distinct terms of one kind of every line."""
    if kind == "e":
        return lines.where(F.col(line).isNotNull()).select(*keep, F.lit("e").alias("term"))
    found = lines.select(*keep, F.array_distinct(_found(F.col(line), kind, _IN_LINE)).alias("_found"))
    # The outer form makes no filter that would find the terms a second time.
    found = found.select(*keep, F.explode_outer("_found").alias("_term"))
    return found.select(*keep, F.concat(F.lit(kind), "_term").alias("term"))


def _kinds(terms: DataFrame) -> list[str]:
    return sorted(r[0] for r in terms.select(F.substring("term", 1, 1)).distinct().collect())


def _of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.substring("term", 1, 1) == kind)


def count_terms(lines: DataFrame, terms: DataFrame, line: str = "line", copied: int = COPIED) -> DataFrame:
    """``term, lines``: how many lines hold each of the distinct ``terms``.

    At most ``copied`` terms of a kind are copied to the tasks, which count only
    those. Of a kind with more of them every term of the lines is counted; either
    way partial counts are all that is shuffled.
    """
    every = []
    for kind in _kinds(terms):
        held, wanted = line_terms(lines, kind, line), _of_kind(terms, kind)
        if is_small(wanted, copied):
            held = held.join(F.broadcast(wanted), "term", "left_semi")
        every.append(held.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("lines")))
    nothing = terms.where("false").select("term", F.lit(0).cast("long").alias("lines"))
    return reduce(DataFrame.unionByName, every, nothing)


def _ranked_index(lines: DataFrame, templates: DataFrame, line: str, copied: int) -> tuple[DataFrame, DataFrame]:
    """The index of ``build_index`` and the counts of terms that it was made of."""
    termed = written_once(template_terms(templates), "templates")
    listed = termed.select("position", F.explode("terms").alias("term"))
    counts = written_once(count_terms(lines, written_once(listed.select("term").distinct(), "terms"), line, copied), "counts")
    rarest = Window.partitionBy("position").orderBy("lines", F.desc(F.length("term")), "term")
    ranked = listed.join(counts, "term", "left").na.fill(0, ["lines"]).withColumn("_rank", F.row_number().over(rarest))
    chosen = ranked.where((F.col("_rank") == 1) & (F.col("lines") > 0)).select("position", "term", "lines")
    return written_once(termed.drop("terms").join(chosen, "position"), "index"), counts


def build_index(lines: DataFrame, templates: DataFrame, line: str = "line", copied: int = COPIED) -> DataFrame:
    """``position, event_id, parts, term, lines``: every template under that of its terms which fewest lines hold.

    Counts how many lines hold each term (``count_terms``). A template with a
    term that no line holds is left out.
    """
    return _ranked_index(lines, templates, line, copied)[0]


def _met(known: DataFrame, index: DataFrame, counts: DataFrame, kind: str, keep: Sequence[str], copied: int) -> list[DataFrame]:
    """Lines next to the templates whose term, of this kind, they hold."""
    index = _of_kind(index, kind)
    terms = line_terms(known, kind, "_line", [*keep, "_line"])
    if is_small(index, copied):
        return [terms.join(F.broadcast(index), "term")]
    most = index.orderBy(F.desc("lines"), "position").limit(copied)
    last = most.agg(F.min(F.struct("lines", -F.col("position"))).alias("last")).select("last.*").toDF("lines", "place").first()
    front = F.lit(False) if last.lines is None else (F.col("lines") > last.lines) | ((F.col("lines") == last.lines) & (F.col("position") <= -last.place))
    rest = index.where(~front)
    rest_terms = rest.select("term").distinct()
    if is_small(rest_terms, copied):
        moved = terms.join(F.broadcast(rest_terms), "term", "left_semi")
    else:
        # Frequent words of lines under which no template of the rest stands would move most of the text.
        other = _of_kind(counts, kind).join(rest_terms, "term", "left_anti").orderBy(F.desc("lines"), "term").limit(copied)
        moved = terms.join(F.broadcast(other.select("term")), "term", "left_anti")
    return [terms.join(F.broadcast(index.where(front)), "term"), moved.join(rest, "term")]


def indexed_matches(
    lines: DataFrame,
    templates: DataFrame,
    key: str,
    line: str = "line",
    carry: Sequence[str] = (),
    copied: int = COPIED,
) -> DataFrame:
    """``key, <carry>, position, event_id`` of every template (position, event_id, template) that occurs in a line.

    The ``copied`` index rows of a kind whose terms most lines hold are copied to
    the tasks and lines stay where they are. Only rarer terms meet the rest of a
    larger index by an equi-join; a line goes there with those of its terms that
    are not among the most frequent ones without a template.
    """
    return _matches(lines, _ranked_index(lines, templates, line, copied), key, line, carry, copied)


def _matches(lines: DataFrame, ranked: tuple[DataFrame, DataFrame], key: str, line: str, carry: Sequence[str], copied: int) -> DataFrame:
    index, counts = ranked
    keep = [key, *carry]
    known = lines.where(F.col(line).isNotNull()).select(*keep, F.col(line).alias("_line"))
    longest = index.agg(F.max(F.size("parts"))).first()[0] or 0
    found = []
    for kind in _kinds(index):
        for met in _met(known, index, counts, kind, keep, copied):
            held = met.where(_holds_first_parts(F.col("_line"), F.col("parts"), min(longest, COMPILED)))
            if longest > COMPILED:
                held = held.where((F.size("parts") <= COMPILED) | holds_parts(F.col("_line"), F.col("parts")))
            found.append(held.select(*keep, "position", "event_id"))
    nothing = known.where("false").select(*keep).crossJoin(index.where("false").select("position", "event_id"))
    return reduce(DataFrame.union, found) if found else nothing


def first_matches(lines: DataFrame, templates: DataFrame, key: str, line: str = "line", copied: int = COPIED) -> DataFrame:
    """``key, event_id``: the matching template that stands first in the file.

    Places are folded before the shuffle, without the names, which are looked up at the end.
    """
    ranked = _ranked_index(lines, templates, line, copied)
    first = _matches(lines, ranked, key, line, (), copied).groupBy(key).agg(F.min("position").alias("position"))
    names = ranked[0].select("position", "event_id").dropDuplicates(["position"])
    return first.join(F.broadcast(names) if is_small(names, copied) else names, "position").select(key, "event_id")


def event_counts(lines: DataFrame, templates: DataFrame, key: str, line: str = "line", copied: int = COPIED) -> DataFrame:
    """``block_id, event_id, cnt`` of all matches; a block without any has one row with a null event and 0 (F1 in long form).

    With thousands of templates the long form takes the place of a wide matrix,
    of which nearly all cells would be 0.
    """
    named = lines.select(key, line, tx.block_id(F.col(line)).alias("block_id")).where(F.col("block_id").isNotNull())
    hits = indexed_matches(named, templates, key, line, ["block_id"], copied)
    # Read twice, and lines are matched once.
    counts = written_once(hits.groupBy("block_id", "event_id").agg(F.count("*").alias("cnt")), "hits")
    bare = named.select("block_id").distinct().join(counts, "block_id", "left_anti")
    return counts.unionByName(bare.select("block_id", F.lit(None).cast("string").alias("event_id"), F.lit(0).cast("long").alias("cnt")))
