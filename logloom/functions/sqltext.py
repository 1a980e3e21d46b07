"""SQL text for expressions over many event columns.

One parsed text per column is much cheaper to build than a tree of API calls.
"""

from __future__ import annotations


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
