"""Constant arrays and maps as one expression (rather than a call per value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pick(values: list[str], index: Column) -> Column:
    """The value at a zero-based index; null outside."""
    return F.get(F.expr(f"array({', '.join(map(_quoted, values))})"), index)


def look_up(mapping: dict[str, str], key: Column) -> Column:
    """The value for a key; null for unknown keys."""
    pairs = ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in mapping.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)
