"""Turning one wide row of aggregates into a small result table."""

from __future__ import annotations

from collections.abc import Sequence


def name(column: str) -> str:
    """A column name as SQL."""
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal as SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stack(columns: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """A ``stack`` expression with one output row per entry of ``rows`` (SQL expressions)."""
    cells = ", ".join(cell for row in rows for cell in row)
    return f"stack({len(rows)}, {cells}) AS ({', '.join(name(c) for c in columns)})"
