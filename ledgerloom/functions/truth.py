"""Presence of values: null, empty text, zero and empty lists all count as missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def number(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c) != 0, F.lit(False))


def date(c: str) -> Column:
    return F.col(c).isNotNull()


def listed(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def score(*parts: tuple[Column, float]) -> Column:
    """The sum of the points whose condition holds."""
    return reduce(lambda a, b: a + b, (F.when(cond, points).otherwise(0.0) for cond, points in parts))


def collected(*parts: tuple[Column, Column | str]) -> Column:
    """An array of the values whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(cond, v if isinstance(v, Column) else F.lit(v)) for cond, v in parts)))
