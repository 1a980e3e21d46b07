"""Documents cut into overlapping chunks by expressions over their separators (R2)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chunk size, overlap and separators in the order they are tried.
CHUNK_SIZE = 200
CHUNK_OVERLAP = 20
SEPARATORS = ("\n\n", "\n", ".", "!", "?", "。", "！", "？", "{", "}")

#: White space that is taken off both ends of a chunk, as a character class.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _cut(text: Column, separator: str) -> Column:
    """The text in pieces, each but the first beginning with the separator."""
    parts = F.split(text, re.escape(separator), -1)
    whole = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p)))
    return F.filter(whole, lambda p: p != "")


def _pieces(text: Column, separators: Sequence[str], size: int, level: int = 0) -> Column:
    """All pieces in order as ``{text, level, opens, whole}``.

    Every level cuts what is still ``size`` or longer at its separator. ``opens``
    marks the first piece of a cut, ``whole`` one that no separator cuts further.
    """

    def piece(text: Column, opens: Column, whole: bool) -> Column:
        return F.array(F.struct(text.alias("text"), F.lit(level).alias("level"), opens.alias("opens"), F.lit(whole).alias("whole")))

    def deeper(text: Column, place: Column) -> Column:
        if level + 1 == len(separators):
            return piece(text, place == 0, True)
        return _pieces(text, separators, size, level + 1)

    return F.flatten(
        F.transform(
            _cut(text, separators[level]),
            lambda p, i: F.when(F.length(p) < size, piece(p, i == 0, False)).otherwise(deeper(p, i)),
        )
    )


def _gather(pieces: Column, size: int, overlap: int) -> Column:
    """Chunks from pieces: a fold that holds the pieces of the chunk at hand.

    Pieces of one cut that lie side by side share chunks; a new cut, another
    level or a whole piece begins anew. When a piece does not fit any more, the
    chunk is closed, and the next begins with as many of its last pieces as have
    ``overlap`` characters at most and leave room for the new one.
    """
    empty = F.array().cast("array<string>")

    def closed(state: Column) -> Column:
        chunk = F.regexp_replace(F.concat_ws("", state["held"]), f"^[{SPACE}]+|[{SPACE}]+$", "")
        return F.when(chunk != "", F.concat(state["out"], F.array(chunk))).otherwise(state["out"])

    def after(out: Column, held: Column, level: Column) -> Column:
        return F.struct(out.alias("out"), held.alias("held"), level.alias("level"))

    def length(held: Column) -> Column:
        return F.length(F.concat_ws("", held))

    def tail(held: Column, room: Column) -> Column:
        start = F.struct(empty.alias("kept"), F.lit(0).alias("sum"))
        taken = F.aggregate(
            F.reverse(held),
            start,
            lambda a, p: F.struct(
                F.when(a["sum"] + F.length(p) <= room, F.concat(F.array(p), a["kept"])).otherwise(a["kept"]).alias("kept"),
                (a["sum"] + F.length(p)).alias("sum"),
            ),
        )
        return taken["kept"]

    def step(state: Column, p: Column) -> Column:
        text, one = p["text"], F.array(p["text"])
        anew = p["opens"] | (p["level"] != state["level"])
        full = length(state["held"]) + F.length(text) > size
        room = F.least(F.lit(overlap), F.lit(size) - F.length(text))
        return (
            F.when(p["whole"], after(F.concat(closed(state), one), empty, F.lit(-1)))
            .when(anew, after(closed(state), one, p["level"]))
            .when(full, after(closed(state), F.concat(tail(state["held"], room), one), p["level"]))
            .otherwise(after(state["out"], F.concat(state["held"], one), p["level"]))
        )

    return F.aggregate(pieces, after(empty, empty, F.lit(-1)), step, closed)


def chunks(
    text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS
) -> Column:
    """Chunks of about ``size`` characters, cut at the coarsest separators that make pieces shorter than that.

    A piece that no separator cuts stays whole, however long. Neighbouring
    chunks share up to ``overlap`` characters. White space at the ends goes;
    chunks of nothing else are left out. Empty texts have no chunks.
    """
    return _gather(_pieces(text, tuple(separators), size), size, overlap)


def chunk_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
) -> DataFrame:
    """One row per chunk: ``key, chunk_no, chunk``. One projection, without a shuffle and without Python."""
    return docs.select(key, F.posexplode(chunks(F.col(text), size, overlap, separators)).alias("chunk_no", "chunk"))
