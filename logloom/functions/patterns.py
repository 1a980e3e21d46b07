"""Event templates as literal patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "[*]"

Template = tuple[str, str]


def template_regex(template: str, mode: str = "literal") -> str:
    """The search pattern of one template.

    ``literal`` quotes the fixed text and lets a wildcard take anything;
    ``raw`` leaves the text as a pattern and lets a wildcard take one word.
    """
    if mode == "raw":
        return template.replace(WILDCARD, r"([^\s]+)")
    if mode != "literal":
        raise ValueError(f"unknown template mode: {mode}")
    quoted = [f"\\Q{part.replace(chr(92) + 'E', _QUOTED_END)}\\E" if part else "" for part in template.split(WILDCARD)]
    return "(?s)" + "(.*?)".join(quoted)


# How a backslash-E that belongs to the text is written inside a quoted span.
_QUOTED_END = "\\E\\\\E\\Q"


def template_regex_column(template: Column) -> Column:
    """``template_regex`` in literal mode for templates held in a column."""
    quoted = F.replace(template, F.lit(WILDCARD), F.lit("\\E(.*?)\\Q"))
    return F.concat(F.lit("(?s)\\Q"), quoted, F.lit("\\E"))


def matches(line: Column, template: str, mode: str = "literal") -> Column:
    """True when the template occurs anywhere in the line.

    A plain substring test on the longest fixed part runs before the pattern,
    so most lines never reach the regular-expression engine.
    """
    if mode == "raw":
        return line.rlike(template_regex(template, mode))
    parts = [p for p in template.split(WILDCARD) if p]
    if not parts:
        return line.isNotNull()
    guard = line.contains(max(parts, key=len))
    return guard if len(parts) == 1 else guard & line.rlike(template_regex(template))


def first_match(line: Column, templates: Sequence[Template], mode: str = "literal") -> Column:
    """Id of the first template, in list order, that occurs in the line; else null."""
    if not templates:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(matches(line, text, mode), F.lit(event)) for event, text in templates])


def all_matches(line: Column, templates: Sequence[Template], mode: str = "literal") -> Column:
    """Ids of every template that occurs in the line, in list order."""
    if not templates:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(matches(line, text, mode), F.lit(event)) for event, text in templates])
    )
