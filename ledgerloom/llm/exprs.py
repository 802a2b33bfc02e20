"""Column expressions that several operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, and what lies between words.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: inside other lambdas a column would be computed anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, without a list of them: each, with the gap that follows, becomes one character."""
    own = F.ltrim(text, F.lit("\t\n\x0b\x0c\r "))
    return F.length(F.regexp_replace(own, F.lit(f"{WORD}+{GAP[:-1]}*+"), F.lit("x"))).cast("long")


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
