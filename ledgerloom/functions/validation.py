"""Rules that records are held against: six scores, issues and warnings.

Each check returns (score, issues, warnings) columns. Issues are structs of type and severity, warnings
types. Time is given (``as_of``), so results can be repeated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scoring, truth
from ledgerloom.schemas import ISSUES, MONEY, WARNINGS

#: Weights of the scores, the oldest date in days, the highest amount.
WEIGHTS = {"amounts": 0.3, "calculations": 0.25, "merchant": 0.15, "items": 0.15, "date_time": 0.1, "data_quality": 0.05}
OLDEST, HIGHEST = 3650, "10000.00"
#: Formats of times and phone numbers, names that are none.
TIMES = (r"^\d{1,2}:\d{2}$", r"^\d{1,2}:\d{2}:\d{2}$", r"^\d{1,2}:\d{2}\s*(am|pm)$")
PHONES = (r"^\d{3}-\d{3}-\d{4}$", r"^\(\d{3}\)\s*\d{3}-\d{4}$", r"^\d{3}\.\d{3}\.\d{4}$", r"^\d{10}$")
NO_NAMES = (r"^[0-9*+=\-]+$", r"^[a-z]{1,2}$", r"^(total|subtotal|tax|cash)$", r"^\*+$")


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(F.rlike(c, F.lit("|".join(f"(?:{p})" for p in patterns))), F.lit(False))


def issue(kind: str, severity: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def no_warnings() -> Column:
    return F.array().cast(WARNINGS)


def reasonable_name(c: Column) -> Column:
    name = F.lower(F.trim(c))
    return ~any_of(name, NO_NAMES) & F.length(name).between(3, 50)


def reasonable_amount(c: Column) -> Column:
    return F.coalesce((c > 0) & (c <= F.lit(HIGHEST).cast(MONEY)) & (c == F.round(c, 2)), F.lit(False))


def valid_time(c: Column) -> Column:
    return any_of(F.lower(c), TIMES)


def valid_phone(c: Column) -> Column:
    return any_of(c, PHONES)


def text_quality(c: Column) -> Column:
    length = F.when(F.length(c) > 50, 0.3).when(F.length(c) > 20, 0.2).otherwise(0.0)
    kinds = ((F.rlike(c, F.lit(r"\p{L}")), 0.3), (F.rlike(c, F.lit(r"\p{Nd}")), 0.2), (F.rlike(c, F.lit(r"[.,;:!?$()\[\]{}]")), 0.2))
    return F.when(F.coalesce(c, F.lit("")) == "", 0.0).otherwise(F.least(F.lit(1.0), length + truth.score(*kinds)))


def merchant() -> tuple[Column, Column, Column]:
    there = truth.text("merchant_name")
    long = there & (F.length(F.trim("merchant_name")) >= 3)
    address = truth.text("merchant_address") & (F.length(F.trim("merchant_address")) >= 10)
    points = truth.score((long, 0.5), (long & reasonable_name(F.col("merchant_name")), 0.3), (address, 0.1), (valid_phone(F.col("merchant_phone")), 0.1))
    issues = truth.collected((there & ~long, issue("merchant_name_too_short", "warning")), (~there, issue("missing_merchant_name", "minor")))
    return F.least(F.lit(1.0), points), issues, no_warnings()


def date_time(as_of: dt.date) -> tuple[Column, Column, Column]:
    there, at = truth.date("date"), F.lit(as_of)
    fine = F.coalesce((F.col("date") <= at) & (F.datediff(at, "date") <= OLDEST), F.lit(False))
    timed, valid = truth.text("time"), valid_time(F.col("time"))
    issues = truth.collected((there & ~fine, issue("unreasonable_date", "warning")), (~there, issue("missing_date", "minor")))
    return truth.score((fine, 0.7), (there & ~fine, 0.3), (timed & valid, 0.3)), issues, truth.collected((timed & ~valid, "invalid_time_format"))


def amounts() -> tuple[Column, Column, Column]:
    total, tax, sub = truth.number("total_amount"), truth.number("tax_amount"), truth.number("subtotal")
    good = {c: truth.number(c) & reasonable_amount(F.col(c)) for c in ("total_amount", "subtotal", "tax_amount", "tip_amount")}
    rated = good["tax_amount"] & sub
    usual = F.coalesce((F.col("tax_amount") * 100 >= F.col("subtotal")) & (F.col("tax_amount") * 5 <= F.col("subtotal")), F.lit(False))
    points = truth.score((good["total_amount"], 0.5), (good["subtotal"], 0.2), (good["tax_amount"], 0.1), (rated & usual, 0.1), (good["tip_amount"], 0.1))
    issues = truth.collected((total & ~good["total_amount"], issue("unreasonable_total", "warning")), (~total, issue("missing_total", "critical")))
    return F.least(F.lit(1.0), points), issues, truth.collected((tax & rated & ~usual, "unusual_tax_rate"))


def items() -> tuple[Column, Column, Column]:
    there = truth.listed("items")

    def timed(x: Column) -> Column:
        return truth.number(x["quantity"]) & truth.number(x["unit_price"]) & truth.number(x["total_price"])

    def agrees(x: Column) -> Column:
        return F.abs(x["unit_price"] * x["quantity"].cast("decimal(12,4)") - x["total_price"]) < F.lit("0.02").cast(MONEY)

    def sound(x: Column) -> Column:
        described = F.coalesce(F.length(F.trim(x["description"])) >= 3, F.lit(False))
        return described | (reasonable_amount(x["total_price"]) & timed(x) & agrees(x))

    share = F.when(there, F.size(F.filter("items", sound)) / F.size("items")).otherwise(0.0)
    wrong = F.transform(F.filter("items", lambda x: timed(x) & ~agrees(x)), lambda x: F.lit("item_calculation_mismatch"))
    return share, truth.collected((~there, issue("no_items", "minor"))), F.coalesce(wrong, no_warnings())


def calculations() -> tuple[Column, Column, Column]:
    there = truth.number("subtotal") & truth.number("tax_amount") & truth.number("total_amount")
    made = F.col("subtotal") + F.col("tax_amount") + F.coalesce(F.col("tip_amount"), F.lit(0).cast(MONEY))
    agrees = there & scoring.near(made, F.col("total_amount"), scoring.CLOSE)
    listed = truth.listed("items") & truth.number("subtotal")
    close = scoring.items_agree(scoring.CLOSE_ITEMS)
    points = F.least(F.lit(1.0), 0.5 + truth.score((agrees, 0.3), (close, 0.2)))
    return points, truth.collected((there & ~agrees, issue("total_calculation_error", "warning"))), truth.collected((listed & ~close, "items_subtotal_mismatch"))


def data_quality() -> tuple[Column, Column, Column]:
    filled = truth.score(
        (truth.text("merchant_name"), 1.0), (truth.date("date"), 1.0), (truth.number("total_amount"), 1.0), (truth.number("subtotal"), 1.0),
        (truth.number("tax_amount"), 1.0), (truth.listed("items"), 1.0), (truth.text("payment_method"), 1.0),
    )
    points = F.coalesce("confidence_score", F.lit(0.0)) * 0.4 + filled / 7 * 0.3 + text_quality(F.col("raw_text")) * 0.3
    return F.least(F.lit(1.0), points), no_issues(), no_warnings()


def checks(as_of: dt.date) -> dict[str, tuple[Column, Column, Column]]:
    """In the order in which issues are listed."""
    return {"merchant": merchant(), "date_time": date_time(as_of), "amounts": amounts(), "items": items(), "calculations": calculations(), "data_quality": data_quality()}


def validate(df: DataFrame, as_of: dt.date, threshold: float = 0.6) -> DataFrame:
    """Adds scores, issues, warnings, validation_score and is_valid; reads raw_text and items."""
    found = checks(as_of)
    out = df.select(
        "*", F.struct(*(s.alias(n) for n, (s, _, _) in found.items())).alias("scores"),
        F.concat(*(i for _, i, _ in found.values())).alias("issues"), F.concat(*(w for _, _, w in found.values())).alias("warnings"),
    )
    overall = sum((F.col(f"scores.{n}") * w for n, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    critical = F.exists("issues", lambda i: i["severity"] == "critical")
    return out.withColumn("validation_score", overall).withColumn("is_valid", (F.round("validation_score", 9) >= threshold) & ~critical)
