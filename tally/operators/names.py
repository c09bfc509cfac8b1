"""Columns by exact name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """Column by exact name (dots, spaces and backticks allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def folded(columns: list[Column], f: Callable[[Column, Column], Column]) -> Column:
    """``f`` over all columns, as a balanced tree: hundreds of them don't make a deep expression."""
    if len(columns) == 1:
        return columns[0]
    half = len(columns) // 2
    return f(folded(columns[:half], f), folded(columns[half:], f))
