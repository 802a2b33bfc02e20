"""Confidence scores of records, as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import truth
from ledgerloom.schemas import MONEY

#: Most difference of sums that still agree, in dollars.
CLOSE, CLOSE_ITEMS = 0.02, 0.05


def items_total() -> Column:
    zero = F.lit(0).cast(MONEY)
    return F.aggregate("items", zero, lambda a, x: (a + F.coalesce(x["total_price"], zero)).cast(MONEY))


def near(a: Column, b: Column, limit: float) -> Column:
    return F.coalesce(F.abs(a - b) < F.lit(f"{limit}").cast(MONEY), F.lit(False))


def sums_agree() -> Column:
    """Total is subtotal plus tax; tips don't count here."""
    there = truth.number("subtotal") & truth.number("tax_amount") & truth.number("total_amount")
    return there & near(F.col("subtotal") + F.col("tax_amount"), F.col("total_amount"), CLOSE)


def items_agree(limit: float = CLOSE) -> Column:
    return truth.listed("items") & truth.number("subtotal") & near(items_total(), F.col("subtotal"), limit)


def consistency() -> Column:
    return F.least(F.lit(1.0), 0.5 + truth.score((sums_agree(), 0.3), (items_agree(), 0.2)))


def basic(ocr_confidence: Column) -> Column:
    name, date, total = truth.text("merchant_name"), truth.date("date"), truth.number("total_amount")
    points = truth.score(
        (name, 1.0), (date, 1.0), (total, 2.0), (truth.number("subtotal"), 1.0), (truth.number("tax_amount"), 1.0), (truth.listed("items"), 1.0), (truth.text("payment_method"), 1.0)
    )
    pattern = 0.5 + truth.score((name & (F.length("merchant_name") > 3), 0.2), (date, 0.2), (total, 0.1))
    return ocr_confidence * 0.4 + points / 8 * 0.3 + consistency() * 0.2 + F.least(F.lit(1.0), pattern) * 0.1


def enhanced(previous: Column) -> Column:
    name = truth.text("merchant_name")
    complete = truth.score((truth.date("date"), 0.2), (truth.number("total_amount"), 0.3), (truth.listed("items"), 0.3), (truth.number("tax_amount"), 0.1), (name, 0.1))
    return F.least(F.lit(1.0), previous * 0.4 + truth.score((name, 0.2)) + complete * 0.3 + consistency() * 0.1)
