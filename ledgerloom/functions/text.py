"""Extraction of typed fields from the text of a record: Column -> Column.

Patterns run on Java's engine with Unicode classes and ``\\n`` as the only line end. A missing match is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scoring
from ledgerloom.schemas import ITEMS, MONEY

# The extraction grammar.
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATES = (
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    MONTH + r"\s+\d{1,2},?\s+\d{2,4}",
    r"\d{1,2}\s+" + MONTH + r"\s+\d{2,4}",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
TIME = r"\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?"
TOTAL = r"(?:total|amount due|balance due|grand total)[:\s]*\$?(\d+\.\d{2})"
SUBTOTAL = r"(?:subtotal|sub total|sub-total)[:\s]*\$?(\d+\.\d{2})"
TAX = r"(?:tax|sales tax|vat)[:\s]*\$?(\d+\.\d{2})"
TIP = r"(?:tip|gratuity)[:\s]*\$?(\d+\.\d{2})"
PHONE = r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
NUMBERS = (r"(?:receipt|ref|reference|order)[#\s:]*([a-z0-9]+)", r"#([a-z0-9]{4,})")
PAYMENT = r"(?:visa|mastercard|amex|american express|discover|cash|credit|debit)(?:\s+ending\s+in\s+(\d{4}))?"
ADDRESSES = (
    r"\d+\s+\w+\s+(st|street|ave|avenue|rd|road|blvd|boulevard|dr|drive|ln|lane|ct|court)",
    r"\w+,\s*[A-Z]{2}\s*\d{5}",
    r"\d{3,5}\s+\w+",
)
ITEM = r"^(.+?)\s+\$?(\d+\.\d{2})$"


def flagged(pattern: str, lines: bool = False) -> str:
    return f"(?iU{'dm' if lines else 'd'}){pattern}"


def first(c: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The group of the leftmost match, null without a match."""
    own = flagged(pattern) if ignore_case else f"(?Ud){pattern}"
    return F.when(F.rlike(c, F.lit(own)), F.regexp_extract(c, own, group))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """All white space, line ends included, becomes single spaces; only printable ASCII stays."""
    out = F.regexp_replace(c, r"(?U)\s+", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, "＄", r"\$"), r"[^\x20-\x7E\n]", ""))


def like_address(c: Column) -> Column:
    return F.rlike(c, F.lit("|".join(flagged(p) for p in ADDRESSES)))


def like_phone(c: Column) -> Column:
    return F.rlike(c, F.lit(flagged(PHONE)))


def merchant_name(text: Column, lines: bool = False) -> Column:
    """The cleaned text, or null where it looks like an address, a phone number or a short heading.

    ``lines`` looks at the first five lines one by one instead: an extension.
    """
    if lines:
        return F.get(F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 5), clean), _fits), F.lit(0))
    return _named(clean(text))


def _fits(x: Column) -> Column:
    capital = (F.upper(x) == x) & (F.lower(x) != x)
    return (F.length(x) > 3) & ~like_address(x) & ~like_phone(x) & ((F.length(x) > 8) | ~capital)


def _named(whole: Column) -> Column:
    return F.when(_fits(whole), whole)


def merchant_address(text: Column) -> Column:
    return _addressed(clean(text))


def _addressed(whole: Column) -> Column:
    return F.when(like_address(whole), whole)


def _date(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.lpad(c, 2, "0")
    return F.concat_ws("-", year, two(month), two(day)).try_cast("date")


def _year(c: Column) -> Column:
    """Four digits as they are; of two, 69 to 99 are in the last century; three are none."""
    century = F.when(c.try_cast("int") >= 69, "19").otherwise("20")
    return F.when(F.length(c) == 4, c).when(F.length(c) == 2, F.concat(century, c))


def _month(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, name in enumerate(MONTHS):
        out = F.when(F.lower(c).isin(name, name[:3]), F.lit(f"{i + 1:02d}")).otherwise(out)
    return out


def date(text: Column) -> Column:
    """The first pattern whose leftmost match is a date decides."""
    return _dated(*(first(text, p) for p in DATES))


def _dated(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The date of the leftmost matches of ``DATES``."""
    get = lambda c, p, g: F.regexp_extract(c, p, g)
    p1, p2 = r"^(\d+)([/-])(\d+)\2(\d+)$", r"^(\d{4})([/-])(\d+)\2(\d+)$"
    p3, p4 = r"^([A-Za-z]+)\s+(\d+),\s+(\d{4})$", r"^(\d+)\s+([A-Za-z]+)\s+(\d{4})$"
    return F.coalesce(
        F.when(F.rlike(a, F.lit(p1)), _date(_year(get(a, p1, 4)), get(a, p1, 1), get(a, p1, 3))),
        F.when(F.rlike(b, F.lit(p2)), _date(get(b, p2, 1), get(b, p2, 3), get(b, p2, 4))),
        F.when(F.rlike(c, F.lit(p3)) & _month(get(c, p3, 1)).isNotNull(), _date(get(c, p3, 3), _month(get(c, p3, 1)), get(c, p3, 2))),
        F.when(F.rlike(d, F.lit(p4)) & _month(get(d, p4, 2)).isNotNull(), _date(get(d, p4, 3), _month(get(d, p4, 2)), get(d, p4, 1))),
    )


def time(text: Column) -> Column:
    return strip(first(text, TIME))


def amount(text: Column, pattern: str) -> Column:
    return first(text, pattern, 1).try_cast(MONEY)


def phone(text: Column) -> Column:
    return first(text, PHONE)


def payment_method(text: Column) -> Column:
    return F.get(F.split(first(text, PAYMENT), r"(?U)\s+"), F.lit(0))


def card_last_four(text: Column) -> Column:
    return F.nullif(first(text, PAYMENT, 1), F.lit(""))


def receipt_number(text: Column) -> Column:
    return F.coalesce(*(first(text, p, 1) for p in NUMBERS))


def item_struct(description: Column, total: Column, confidence: float, quantity: Column | None = None, unit: Column | None = None) -> Column:
    return F.struct(
        description.alias("description"), (F.lit(None) if quantity is None else quantity).cast("double").alias("quantity"),
        (F.lit(None) if unit is None else unit).cast("decimal(18,6)").alias("unit_price"), total.cast(MONEY).alias("total_price"), F.lit(confidence).alias("confidence"),
    )


def lines_of(text: Column) -> Column:
    """Stripped lines of at least five characters."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: F.length(x) >= 5)


def items(text: Column) -> Column:
    """An item for each line that ends in a price; totals are lines like others."""
    own = f"(?Ud){ITEM}"
    priced = F.filter(lines_of(text), lambda x: F.rlike(x, F.lit(own)))
    made = F.transform(priced, lambda x: item_struct(strip(F.regexp_extract(x, own, 1)), F.regexp_extract(x, own, 2).try_cast(MONEY), 0.8))
    return F.coalesce(made.cast(ITEMS), F.array().cast(ITEMS))


def extract(df: DataFrame, text_col: str = "raw_text", ocr_col: str = "ocr_confidence") -> DataFrame:
    """Adds every field and the basic confidence score. A null text gives nulls and no items."""
    t = F.col(text_col)
    # what several expressions read has a column of its own: it is found once
    once = {"_whole": clean(t), **{f"_date{i}": first(t, p) for i, p in enumerate(DATES)}}
    out = df.withColumns(once).withColumns(
        {
            "merchant_name": _named(F.col("_whole")), "merchant_address": _addressed(F.col("_whole")), "merchant_phone": phone(t), "date": _dated(*(F.col(c) for c in list(once)[1:])), "time": time(t),
            "total_amount": amount(t, TOTAL), "subtotal": amount(t, SUBTOTAL), "tax_amount": amount(t, TAX), "tip_amount": amount(t, TIP),
            "payment_method": payment_method(t), "card_last_four": card_last_four(t), "receipt_number": receipt_number(t), "items": items(t),
        }
    )
    return out.drop(*once).withColumn("confidence_score", scoring.basic(F.col(ocr_col)))
