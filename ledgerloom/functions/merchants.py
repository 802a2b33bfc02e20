"""Merchant templates, further item patterns, categories of items: Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scoring
from ledgerloom.functions.text import item_struct, lines_of, strip
from ledgerloom.schemas import ITEM, ITEMS, MONEY

# Templates in the order in which they are tried. An item pattern comes with the groups
# of quantity (0: none), description and price, and the confidence of its items.
NAMES = {
    "walmart": (r"walmart.*supercenter", r"walmart.*store"),
    "target": (r"target", r"target.*store"),
    "costco": (r"costco.*wholesale",),
    "grocery": (r"kroger", r"safeway", r"publix", r"whole foods", r"trader.*joe"),
    "restaurant": (r"mcdonald", r"burger.*king", r"subway", r"starbucks", r"pizza"),
}
ITEMS_OF = {
    "walmart": ((r"^([A-Z0-9\s]+)\s+(\d{12})\s*([TNX])\s*(\d+\.\d{2})$", 0, 1, 4, 0.9), (r"^([A-Z0-9\s]+)\s+(\d+\.\d{2})\s*([TNX])$", 0, 1, 2, 0.9)),
    "target": ((r"^(.+?)\s+(\d{3}-\d{2}-\d{4})\s*(\d+\.\d{2})\s*([TNX])$", 0, 1, 3, 0.9),),
    "costco": ((r"^(\d+)\s+(.+?)\s+(\d+\.\d{2})$", 1, 2, 3, 0.9),),
    "grocery": ((r"^(.+?)\s+(\d+\.\d{2})\s*([FT])$", 0, 1, 2, 0.8), (r"^(.+?)\s+(\d+\.\d{2})$", 0, 1, 2, 0.8)),
    "restaurant": ((r"^(\d+)\s*x\s*(.+?)\s+(\d+\.\d{2})$", 1, 2, 3, 0.9), (r"^(.+?)\s+(\d+\.\d{2})$", 0, 1, 2, 0.8)),
}
AMOUNTS = {"total_amount": r"total\s*(\d+\.\d{2})", "tax_amount": r"tax\s*(\d+\.\d{2})", "tip_amount": r"tip\s*(\d+\.\d{2})"}
AMOUNTS_OF = {"total_amount": tuple(NAMES), "tax_amount": ("walmart",), "tip_amount": ("restaurant",)}
EXTRA = (r"^([A-Z][A-Z\s&]+)\s+\$(\d+\.\d{2})$", r"^([A-Za-z][A-Za-z\s\-&'.]+)\s+\$?(\d+\.\d{2})$", r"^(\d+)\s*@\s*\$?(\d+\.\d{2})\s*=\s*\$?(\d+\.\d{2})$")
NO_ITEMS = (r"^\d+$", r"^[A-Z]{1,2}$", "total", "subtotal", "tax", "cash", "change", "visa", "mastercard", "thank you", "receipt", r"store.*\d+", r"^\*+$", r"^-+$")
CATEGORIES = {
    "food": ("milk", "bread", "eggs", "cheese", "butter", "yogurt", "meat", "chicken", "beef", "fish", "salmon", "fruit", "apple", "banana", "orange", "vegetable", "tomato", "potato", "onion", "lettuce", "cereal", "pasta", "rice", "beans", "soup"),
    "beverages": ("water", "soda", "juice", "coffee", "tea", "beer", "wine", "energy drink"),
    "household": ("detergent", "shampoo", "soap", "toothpaste", "toilet paper", "paper towel", "cleaner", "dish soap", "trash bag"),
    "pharmacy": ("medicine", "vitamin", "aspirin", "bandaid", "thermometer", "prescription"),
    "clothing": ("shirt", "pants", "shoes", "dress", "jacket", "socks", "underwear"),
    "electronics": ("phone", "charger", "battery", "cable", "headphone", "speaker"),
}


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def first_of(pairs: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*(F.when(cond, value) for cond, value in pairs))


def merchant_type(text: Column) -> Column:
    low = F.lower(text)
    return first_of([(F.rlike(low, F.lit("|".join(f"(?:(?Ud){p})" for p in patterns))), name) for name, patterns in NAMES.items()])


def category(description: Column) -> Column:
    return first_of([(contains_any(F.lower(description), words), name) for name, words in CATEGORIES.items()])


def _found(text: Column, pattern: str, qty: int, desc: int, price: int, confidence: float, digits: bool) -> Column:
    """Items of one pattern; where ``digits``, an all-digit description is taken for a quantity and dropped."""
    own = F.lit(f"(?Udm){pattern}")
    parts = F.arrays_zip(*(F.regexp_extract_all(text, own, F.lit(g)).alias(n) for n, g in (("q", qty or desc), ("d", desc), ("p", price))))
    if digits and not qty:
        parts = F.filter(parts, lambda x: ~F.rlike(x["d"], F.lit(r"^\d+$")))

    def made(x: Column) -> Column:
        total = x["p"].try_cast(MONEY)
        n = x["q"].try_cast("double") if qty else None
        unit = None if n is None else F.when(n > 0, total / n.cast("decimal(12,0)")).otherwise(total.cast("decimal(38,20)"))
        return item_struct(strip(x["d"]), total, confidence, n, unit)

    return F.transform(parts, made).cast(ITEMS)


def template_items(text: Column, kind: Column) -> Column:
    """Items of all patterns of the template, in pattern order; empty without a template."""
    out = F.array().cast(ITEMS)
    for name, patterns in ITEMS_OF.items():
        own = F.concat(*(_found(text, *p, digits=name in ("grocery", "restaurant")) for p in patterns))
        out = F.when(kind == name, own).otherwise(out)
    return out


def template_amount(text: Column, kind: Column, field: str) -> Column:
    """The template's amount, null where it has none."""
    own = f"(?iUd){AMOUNTS[field]}"
    return F.when(kind.isin(*AMOUNTS_OF[field]) & F.rlike(text, F.lit(own)), F.regexp_extract(text, own, 1).try_cast(MONEY))


def apply_template(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Adds merchant_type; a template's items and amounts take the place of what was extracted."""
    t = F.col(text_col)
    out = df.withColumn("merchant_type", merchant_type(t)).withColumn("found", template_items(t, F.col("merchant_type")))
    new = {f: F.coalesce(template_amount(t, F.col("merchant_type"), f), F.col(f)) for f in AMOUNTS}
    return out.withColumns({**new, "items": F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("items"))}).drop("found")


def valid_description(c: Column) -> Column:
    bad = F.rlike(F.lower(c), F.lit("|".join(f"(?:{p})" for p in NO_ITEMS)))
    return ~bad & F.length(c).between(3, 50) & F.rlike(c, F.lit("[a-zA-Z]"))


def extra_item(line: Column) -> Column:
    """An item of a line by the further patterns, null if none fits."""
    one, two, three = (f"(?Ud){p}" for p in EXTRA)

    def plain(p: str) -> Column:
        d = strip(F.regexp_extract(line, p, 1))
        good = F.rlike(line, F.lit(p)) & (F.length(d) > 2) & valid_description(d)
        return F.when(good, item_struct(d, F.regexp_extract(line, p, 2).try_cast(MONEY), 0.7).cast(ITEM))

    n, unit, total = (F.regexp_extract(line, three, g) for g in (1, 2, 3))
    agree = F.abs(unit.try_cast(MONEY) * n.try_cast("decimal(12,0)") - total.try_cast(MONEY)) < F.lit("0.02").cast(MONEY)
    name = F.concat(F.lit("Item (qty: "), n.try_cast("double").cast("string"), F.lit(")"))
    counted = F.when(F.rlike(line, F.lit(three)) & agree, item_struct(name, total.try_cast(MONEY), 0.8, n.try_cast("double"), unit.try_cast(MONEY)).cast(ITEM))
    return F.coalesce(plain(one), plain(two), counted)


#: Items beside a text that they are compared by, so that it is made once for each item and not for each pair.
_KEYED = f"array<struct<key:string,item:{ITEM}>>"


def _keyed(key: Column, item: Column) -> Column:
    return F.struct(key.alias("key"), item.alias("item"))


def dedup(items: Column) -> Column:
    """The first item of each description, by its lower-case stripped form."""
    keyed = F.transform(items, lambda x: _keyed(strip(F.lower(x["description"])), x))
    step = lambda a, x: F.when(F.exists(a, lambda y: y["key"] == x["key"]), a).otherwise(F.concat(a, F.array(x)))
    return F.transform(F.aggregate(keyed, F.array().cast(_KEYED), step), lambda x: x["item"])


def enhance(text: Column, items: Column) -> Column:
    """Adds items of lines that no description so far occurs in, line after line, then drops repeats."""
    own = lambda x: _keyed(F.lower(x["description"]), x)

    def step(a: Column, line: Column) -> Column:
        held = F.exists(a, lambda x: F.contains(line["low"], x["key"]))
        more = F.filter(F.array(extra_item(line["line"])), lambda x: x.isNotNull())
        return F.when(held, a).otherwise(F.concat(a, F.transform(more, own)))

    lines = F.transform(F.coalesce(lines_of(text), F.array().cast("array<string>")), lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    all_items = F.aggregate(lines, F.transform(items.cast(ITEMS), own).cast(_KEYED), step)
    return dedup(F.transform(all_items, lambda x: x["item"]))


def parse(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Template, further items, categories, new score, on extracted records."""
    out = apply_template(df, text_col).withColumn("items", enhance(F.col(text_col), F.col("items")))
    out = out.withColumn("categories", F.transform("items", lambda x: category(x["description"])))
    return out.withColumn("confidence_score", scoring.enhanced(F.col("confidence_score")))
