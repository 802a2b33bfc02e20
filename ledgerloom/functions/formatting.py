"""Formatting of values for export: Column -> Column of text, and the open registry of field formatters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.merchants import contains_any, first_of

# Categories of items, the first that matches decides.
BUSINESS = {"Meals": ("meal", "food", "restaurant", "lunch", "dinner"), "Travel": ("gas", "fuel", "station"), "Office Supplies": ("office", "supply", "paper", "pen")}
TAX = {"Medical": ("medical", "pharmacy", "doctor"), "Business Expense": ("office", "business"), "Charitable": ("donation", "charity")}
ACCOUNTS = {"6200": ("meal", "food", "restaurant"), "6100": ("gas", "fuel"), "6300": ("office", "supply")}


def currency(amount: Column, symbol: str = "$", places: int = 2, before: bool = True) -> Column:
    """Fixed places without separators; empty for null."""
    text = amount.cast(f"decimal(18,{places})").cast("string")
    return F.coalesce(F.concat(F.lit(symbol), text) if before else F.concat(text, F.lit(symbol)), F.lit(""))


def currency_text(c: Column) -> Column:
    """The same for amounts given as text, which may hold a symbol and separators; others stay as they are."""
    bare = F.trim(F.translate(c, "$,", ""))
    return F.when(F.coalesce(bare, F.lit("")) == "", "").otherwise(F.coalesce(F.concat(F.lit("$"), F.round(bare.try_cast("decimal(30,10)"), 2).cast("decimal(18,2)").cast("string")), c))


def date(d: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.coalesce(F.date_format(d, pattern), F.lit(""))


def date_text(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date given as text: ISO, month first, day first, month first with dashes; others stay as they are."""
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"))
    found = F.coalesce(*(F.when(F.rlike(c, F.lit(p)), F.try_to_timestamp(c, F.lit(f))) for p, f in forms))
    return F.coalesce(F.date_format(found, pattern), c, F.lit(""))


def phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    local = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    made = F.concat(F.lit("("), F.substring(local, 1, 3), F.lit(") "), F.substring(local, 4, 3), F.lit("-"), F.substring(local, 7, 4))
    return F.coalesce(made, c, F.lit(""))


def quantity(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.round(c, 2).cast("decimal(18,2)").cast("string"))


def percentage(c: Column) -> Column:
    return F.coalesce(F.concat(F.round(c * 100, 1).cast("decimal(9,1)").cast("string"), F.lit("%")), F.lit(""))


def filename(c: Column) -> Column:
    """Letters, digits, spaces, - and _ stay; spaces become _."""
    return F.replace(F.rtrim(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "")), F.lit(" "), F.lit("_"))


def _of_item(description: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return first_of([(contains_any(F.lower(description), words), name) for name, words in table.items()])


def items_summary(items: Column) -> Column:
    named = F.filter(F.transform(items, lambda x: x["description"]), lambda d: F.coalesce(d, F.lit("")) != "")
    return F.array_join(F.slice(named, 1, 3), "; ")


def items_business(items: Column) -> Column:
    kinds = F.transform(items, lambda x: F.coalesce(_of_item(x["description"], BUSINESS), F.lit("General")))
    return F.array_join(F.array_sort(F.array_distinct(kinds)), "; ")


def _first_hit(items: Column, table: dict[str, tuple[str, ...]], default: str) -> Column:
    hits = F.filter(F.transform(items, lambda x: _of_item(x["description"], table)), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(default))


def tax_category(items: Column) -> Column:
    return _first_hit(items, TAX, "General")


def accounting_code(items: Column) -> Column:
    return _first_hit(items, ACCOUNTS, "6000")


#: Formatters of items that read descriptions only.
OF_DESCRIPTIONS = (items_summary, items_business, tax_category, accounting_code)
#: Formatters by name; ``register`` adds further ones. They see only values that are present.
FORMATTERS: dict[str, Callable[[Column], Column]] = {
    "currency": lambda c: F.when(F.rlike(c, F.lit(r"^[0-9.,]*[0-9][0-9.,]*$")), F.concat(F.lit("$"), c)).otherwise(c),
    "percentage": lambda c: c,
    "boolean": lambda c: F.when(c, "Yes").otherwise("False"),
    "items_summary": items_summary,
    "items_business": items_business,
    "tax_category": tax_category,
    "accounting_code": accounting_code,
    "phone": lambda c: F.when(F.length(F.regexp_replace(c, r"\D", "")) == 10, phone(c)).otherwise(c),
}


def register(name: str, formatter: Callable[[Column], Column]) -> None:
    FORMATTERS[name] = formatter
