"""Text expressions over log lines and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a line is stripped of, the two block-id forms,
# the words that mark an unmatched line as an error.
BLANKS = " \t\r\n\f\v"
STRICT_BLOCK = r"(blk_[\-0-9]+)"
LENIENT_BLOCK = r"(blk[-_]?-?\d+)"
ERROR_WORDS = "(?i)ERROR|FATAL|CRITICAL|Exception|Failed|Corrupt|timeout|unavailable|invalid"


def clean_line(value: Column) -> Column:
    """Strip a line; bytes that are not UTF-8 are dropped."""
    decoded = F.when(F.is_valid_utf8(value), value).otherwise(
        F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit(""))
    )
    return F.btrim(decoded, F.lit(BLANKS))


def block_id(line: Column, lenient: bool = False) -> Column:
    """The block a line is about.

    Strict: null when there is none. Lenient: also ``blk123`` and ``blk-123``,
    and ``'unknown'`` when there is none.
    """
    found = F.nullif(F.regexp_extract(line, LENIENT_BLOCK if lenient else STRICT_BLOCK, 1), F.lit(""))
    return F.coalesce(found, F.lit("unknown")) if lenient else found


def has_error_word(line: Column) -> Column:
    """True when an unmatched line still reads like an error."""
    return line.rlike(ERROR_WORDS)


def duration_seconds(text: Column) -> Column:
    """``1h30m15s`` to seconds (X13); without a unit hours are meant, default one hour."""
    cleaned = F.lower(F.btrim(text, F.lit(BLANKS)))
    factor = F.create_map(*[F.lit(x) for p in {"s": 1, "m": 60, "h": 3600, "d": 86400}.items() for x in p])
    parts = F.regexp_extract_all(cleaned, F.lit(r"\d+[smhd]"), F.lit(0))
    total = F.aggregate(
        parts,
        F.lit(0).cast("bigint"),
        lambda acc, p: acc
        + p.substr(F.lit(1), F.length(p) - 1).cast("bigint") * F.element_at(factor, F.right(p, F.lit(1))),
    )
    leading = _leading_int(cleaned)
    return F.when(total != 0, total).otherwise(F.coalesce(leading, F.lit(1)) * 3600).cast("bigint")


def _leading_int(text: Column) -> Column:
    number = F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("bigint")
    return F.when(number != 0, number)


def keywords(text: Column) -> Column:
    """Letter, digit and underscore words of a question."""
    return F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9_]+"), F.lit(0))


def truncate(text: Column, length: int = 200) -> Column:
    """The first characters of a line, for display."""
    return F.substring(text, 1, length)


# What counts as a variable in a line, from the most specific.
VARIABLES = [
    r"blk_-?\d+",
    r"/?\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?",
    r"\b\d{6} \d{6}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d+\b",
]


def mask_variables(line: Column) -> Column:
    """Replace addresses, dates and ids by ``<*>`` so equal lines fold together.

    One alternation, so a line is searched once; the look-ahead skips places
    where no variable can start.
    """
    return F.regexp_replace(line, f"(?=[b/0-9])(?:{'|'.join(VARIABLES)})", "<*>")
