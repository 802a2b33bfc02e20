"""64-bit hashes of vectors and their similarity: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def _bits(bits: Column) -> Column:
    """Booleans as a BIGINT, the first one highest."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(F.when(b, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))


def median_hash(v: Column) -> Column:
    """A bit for each of 64 numbers: greater than their median, the mean of the middle two."""
    ranked = F.array_sort(F.transform(v, lambda x: x.cast("double")))
    middle = (F.get(ranked, F.lit(BITS // 2 - 1)) + F.get(ranked, F.lit(BITS // 2))) / 2
    held = F.transform(F.array(middle), lambda m: _bits(F.transform(v, lambda x: x.cast("double") > m)))
    return F.get(held, F.lit(0))


def gradient_hash(v: Column, width: int = 8) -> Column:
    """A bit for each number and its right neighbour in rows of ``width``: the neighbour is greater."""
    inner = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: i % width != width - 1)
    return _bits(F.transform(inner, lambda i: F.get(v, i + 1) > F.get(v, i)))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def grid_quality(v: Column, width: int = 8) -> dict[str, Column]:
    """Sharpness (variance of the Laplacian, borders mirrored), brightness, contrast of a grid of numbers."""
    n = F.size(v)
    x = F.transform(v, lambda e: e.cast("double"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + e) / F.size(c)
    spread = lambda c: F.get(F.transform(F.array(mean(c)), lambda m: F.aggregate(c, F.lit(0.0), lambda a, e: a + (e - m) * (e - m)) / F.size(c)), F.lit(0))
    at = lambda i: F.get(v, i).cast("double")
    left = lambda i: F.when(i % width == 0, i + 1).otherwise(i - 1)
    right = lambda i: F.when(i % width == width - 1, i - 1).otherwise(i + 1)
    up = lambda i: F.when(i < width, i + width).otherwise(i - width)
    down = lambda i: F.when(i >= n - width, i - width).otherwise(i + width)
    laplace = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(left(i)) + at(right(i)) + at(up(i)) + at(down(i)) - at(i) * 4)
    return {"sharpness": spread(laplace), "brightness": mean(x), "contrast": F.sqrt(spread(x))}
