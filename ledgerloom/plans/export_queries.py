"""Queries of formatting, templates and sheets: (Spark plan, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import formatting as fmt
from ledgerloom.functions import validation as V
from ledgerloom.operators import analytics as A
from ledgerloom.plans import export
from ledgerloom.plans.scoring_queries import _OVERALL, AS_OF, _facts
from ledgerloom.sources.records import money_sql, read, records, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, plan, text: str, items: bool = False, raw: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(records(spark, sf_dir, items=items, text=raw))
    SQL[name] = sql(text, items=items, text=raw)


_fields = lambda r, **cols: r.select("file_id", *(c.alias(n) for n, c in cols.items()))
_PHONE = "coalesce('(' || substr(merchant_phone, 1, 3) || ') ' || substr(merchant_phone, 4, 3) || '-' || substr(merchant_phone, 7), '')"


def _usd(c: str, symbol: str = "$") -> str:
    return f"coalesce('{symbol}' || {money_sql(c)}, '')"


def _pct(permille: str) -> str:
    return f"(({permille}) // 10) || '.' || (({permille}) % 10) || '%'"


_OCR, _CONF, _BOTH = _pct("k % 101 * 10"), _pct("k * 7 % 101 * 10"), _pct("(k % 101 + k * 7 % 101) * 5")
add("fmt_currency", lambda r: _fields(r, total=fmt.currency(F.col("total_amount")), tip=fmt.currency(F.col("tip_amount")), text=fmt.currency_text(F.concat(F.lit(" $"), F.col("total_amount").cast("string")))), f"SELECT file_id, {_usd('total_c')} AS total, {_usd('tip_c')} AS tip, {_usd('total_c')} AS text FROM r")
_shown = lambda: F.when(F.col("k") % 4 == 0, F.date_format("date", "yyyy-MM-dd")).when(F.col("k") % 4 == 1, F.date_format("date", "MM/dd/yyyy")).when(F.col("k") % 4 == 2, F.date_format("date", "MM-dd-yyyy")).otherwise("some day")
add("fmt_date", lambda r: _fields(r, date=fmt.date_text(_shown())), "SELECT file_id, CASE WHEN k % 4 = 3 THEN 'some day' ELSE coalesce(strftime(dt, '%Y-%m-%d'), '') END AS date FROM r")
add("fmt_phone", lambda r: _fields(r, phone=fmt.phone(F.when(F.col("k") % 3 == 0, F.concat(F.lit("+1 "), "merchant_phone")).when(F.col("k") % 3 == 1, F.col("merchant_phone")).otherwise("12-34"))), f"SELECT file_id, CASE WHEN k % 3 = 2 THEN '12-34' ELSE {_PHONE} END AS phone FROM r")
add("fmt_quantity", lambda r: _fields(r, quantity=fmt.quantity(F.when(F.col("k") % 5 != 0, F.col("k") % 8 / 4))), "SELECT file_id, CASE WHEN k % 5 = 0 THEN '' WHEN k % 4 = 0 THEN (k % 8 // 4)::VARCHAR ELSE (k % 8 // 4) || '.' || lpad((k % 4 * 25)::VARCHAR, 2, '0') END AS quantity FROM r")
add("fmt_percentage", lambda r: _fields(r, ocr=fmt.percentage(F.col("ocr_confidence")), overall=fmt.percentage((F.col("ocr_confidence") + F.col("confidence_score")) / 2)), f"SELECT file_id, {_OCR} AS ocr, {_BOTH} AS overall FROM r")
add(
    "clean_filename", lambda r: _fields(r, name=fmt.filename(F.concat(F.coalesce("merchant_name", F.lit("Unknown")), F.lit(" #"), F.col("k").cast("string"), F.lit(": receipt_"), F.lit("x-1.pdf ")))),
    "SELECT file_id, replace(coalesce(merchant_name, 'Unknown') || ' ' || k || ' receipt_x-1pdf', ' ', '_') AS name FROM r",
)


def _flat(r: DataFrame) -> DataFrame:
    x = export.formatted(A.valid(r))
    return x.select(
        "file_id", F.col("merchant.name").alias("name"), F.col("merchant.phone").alias("phone"), F.col("transaction.date").alias("date"), F.col("transaction.time").alias("time"), F.col("amounts.total").alias("total"),
        F.col("amounts.tip").alias("tip"), F.col("metadata.items_count").alias("items_count"), F.col("confidence.overall_confidence").alias("overall"),
    )


_N = "n AS (SELECT k, count(*) AS n, string_agg(description, '; ' ORDER BY pos) FILTER (pos <= 3) AS first3 FROM i1 GROUP BY k)"
_OKV = "success AND confidence_score > 0"
add(
    "format_records", _flat,
    f"""WITH {_N} SELECT file_id, merchant_name AS name, {_PHONE} AS phone, coalesce(dt::VARCHAR, '') AS date, coalesce(tm, '') AS time, {_usd('total_c')} AS total, {_usd('tip_c')} AS tip, coalesce(n, 0)::INT AS items_count, {_BOTH} AS overall
    FROM r LEFT JOIN n ON r.k = n.k""".replace("{_BOTH}", _BOTH).replace(_BOTH, _BOTH.replace("k ", "r.k ")) + f" WHERE {_OKV}", items=True,
)
add(
    "format_items",
    lambda r: export.formatted(A.valid(r)).select("file_id", F.posexplode("items").alias("pos", "x")).select("file_id", "pos", "x.description", "x.quantity", "x.unit_price", "x.total_price", "x.confidence"),
    f"""SELECT r.file_id, (pos - 1)::INT AS pos, description, quantity::INT::VARCHAR AS quantity, {_usd('unit_c')} AS unit_price, {_usd('line_c')} AS total_price, '80.0%' AS confidence FROM r JOIN i1 ON r.k = i1.k WHERE {_OKV}""", items=True,
)

# Descriptions with the words that categories look for.
_WORDS = ("office chair", "gas can", "doctor visit", "lunch menu", "charity box", "stationery", "plain", "paper", "business card", "dinner")
_word = lambda: F.get(F.array(*map(F.lit, _WORDS)), (F.col("k") % 10).cast("int"))


def _worded(r: DataFrame) -> DataFrame:
    return r.withColumn("word", _word()).withColumn("items", F.transform("items", lambda x, i: x.withField("description", F.when(i == 1, F.concat(x["description"], F.lit(" "), F.col("word"))).otherwise(x["description"]))))


_W = f"w AS (SELECT i1.*, lower(CASE WHEN pos = 2 THEN description || ' ' || {list(_WORDS)}[k % 10 + 1] ELSE description END) AS d FROM i1)"


def _hit(table: dict) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(d, '{w}')" for w in words) + f" THEN '{name}'" for name, words in table.items()) + " END"


def _first(table: dict, default: str) -> str:
    return f"coalesce(first({_hit(table)} ORDER BY pos) FILTER ({_hit(table)} IS NOT NULL), '{default}')"


add("items_summary", lambda r: _fields(r.where("size(items) > 0"), summary=fmt.items_summary(F.col("items"))), f"WITH {_N} SELECT 'f' || k AS file_id, first3 AS summary FROM n", items=True)
add(
    "items_business", lambda r: _fields(_worded(r.where("size(items) > 0")), purpose=fmt.items_business(F.col("items"))),
    f"WITH {_W} SELECT 'f' || k AS file_id, array_to_string(list_sort(list_distinct(list(coalesce({_hit(fmt.BUSINESS)}, 'General')))), '; ') AS purpose FROM w GROUP BY k", items=True,
)
add("tax_category", lambda r: _fields(_worded(r.where("size(items) > 0")), category=fmt.tax_category(F.col("items"))), f"WITH {_W} SELECT 'f' || k AS file_id, {_first(fmt.TAX, 'General')} AS category FROM w GROUP BY k", items=True)
add("accounting_code", lambda r: _fields(_worded(r.where("size(items) > 0")), code=fmt.accounting_code(F.col("items"))), f"WITH {_W} SELECT 'f' || k AS file_id, {_first(fmt.ACCOUNTS, '6000')} AS code FROM w GROUP BY k", items=True)
add(
    "deductible", lambda r: _worded(A.valid(r)).withColumn("category", fmt.tax_category(F.col("items"))).where("category <> 'General'").groupBy("category").agg(A.total().alias("total_spent")),
    f"""WITH {_W}, c AS (SELECT k, {_first(fmt.TAX, 'General')} AS category FROM w GROUP BY k)
    SELECT category, sum(total_c) / 100.0::DOUBLE AS total_spent FROM r JOIN c ON r.k = c.k WHERE {_OKV} AND category <> 'General' GROUP BY 1""", items=True,
)

_VALIDITY = f"CASE WHEN round(({_OVERALL}), 9) >= 0.6 AND has_total THEN 'Yes' ELSE 'False' END"
_BIZ, _TAXC, _ACC = "'General'", "'General'", "'6000'"  # the parts' names hold none of the words


def _template(key: str, name: str, select: str) -> None:
    t = export.TEMPLATES[name]
    add(key, lambda r: export.apply(V.validate(A.valid(r), AS_OF), t, "file_id"), _facts(f"SELECT file_id, {select} FROM f LEFT JOIN g ON f.k = g.k WHERE {_OKV}", "t").replace("WITH ", "WITH g AS (SELECT k, string_agg(description, '; ' ORDER BY pos) FILTER (pos <= 3) AS first3 FROM i1 GROUP BY k), ", 1), items=True, raw=True)


def _q(names: list[str], exprs: list[str]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in zip(names, exprs))


_FK = lambda s: s.replace("k ", "f.k ")
_US, _ISO = "coalesce(strftime(dt, '%m/%d/%Y'), '')", "coalesce(dt::VARCHAR, '')"
_names = lambda n: [m.name for m in export.TEMPLATES[n].fields]
_empty = lambda v: f"CASE WHEN n_items = 0 THEN '[]' ELSE {v} END"
_template("tmpl_personal", "personal_expenses", _q(_names("personal_expenses"), [_US, "merchant_name", _usd("total_c"), _usd("tax_c"), "payment_method", _empty("first3"), "n_items::VARCHAR", _FK(_CONF)]))
_template(
    "tmpl_business", "business_expenses",
    _q([*_names("business_expenses"), *export.TEMPLATES["business_expenses"].constants], [_ISO, "merchant_name", "merchant_address", _usd("subtotal_c"), _usd("tax_c"), _usd("total_c"), "payment_method", "receipt_number", _empty(_BIZ), _VALIDITY, "''", "''", "''", "'Pending'"]),
)
_template("tmpl_tax", "tax_preparation", _q(_names("tax_preparation"), [_US, "merchant_name", _usd("total_c"), _usd("tax_c"), "payment_method", _empty(_TAXC), "merchant_address", _VALIDITY]))
_template("tmpl_accounting", "accounting", _q(_names("accounting"), [_ISO, "merchant_name", _usd("total_c"), _usd("tax_c"), "payment_method", _empty(_ACC), "receipt_number", "merchant_address", "file_name"]))
_template(
    "tmpl_detailed", "detailed_analysis",
    _q(_names("detailed_analysis"), ["file_name", _ISO, "coalesce(tm, '')", "merchant_name", "merchant_address", _PHONE, _usd("subtotal_c"), _usd("tax_c"), _usd("tip_c"), _usd("total_c"), "payment_method", "card_last_four", "receipt_number", "n_items::VARCHAR", "ocr_method", _FK(_OCR), _FK(_CONF), _VALIDITY.replace("'Yes'", "'True'")]),
)


def _rows(r: DataFrame) -> DataFrame:
    x = A.successful(r).select("file_name", "merchant_name", F.col("date").cast("string").alias("date"), "total_c", "ocr_method", F.posexplode_outer("items").alias("pos", "x"))
    return x.select("file_name", "merchant_name", "date", "total_c", "ocr_method", "pos", F.col("x.description").alias("item_description"), F.col("x.quantity").alias("item_quantity"), F.col("x.total_price").cast("string").alias("item_total_price"), F.col("x.confidence").alias("item_confidence"))


add(
    "csv_rows", _rows,
    f"""SELECT file_name, merchant_name, dt::VARCHAR AS date, total_c, ocr_method, (pos - 1)::INT AS pos, description AS item_description, quantity AS item_quantity, {money_sql('line_c')} AS item_total_price,
      CASE WHEN pos IS NOT NULL THEN 0.8::DOUBLE END AS item_confidence FROM r LEFT JOIN i1 ON r.k = i1.k WHERE success""", items=True,
)
_sheet = lambda r: _rows(r).select("file_name", "merchant_name", "date", "pos", F.coalesce("item_description", F.lit("(No items detected)")).alias("item_description"), "item_quantity", "item_total_price")
_SHEET = f"""SELECT file_name, merchant_name, dt::VARCHAR AS date, (pos - 1)::INT AS pos, coalesce(description, '(No items detected)') AS item_description, quantity AS item_quantity, {money_sql('line_c')} AS item_total_price
  FROM r LEFT JOIN i1 ON r.k = i1.k WHERE success"""
add("sheet_items", _sheet, _SHEET, items=True)
add(
    "line_items", lambda r: r.select("file_id", F.explode_outer("items").alias("x")).groupBy("file_id").agg(F.count("x").alias("n_items"), F.coalesce(F.sum("x.total_price"), F.lit(0)).cast("double").alias("items_total")),
    "SELECT r.file_id, count(pos) AS n_items, coalesce(sum(line_c), 0) / 100.0::DOUBLE AS items_total FROM r LEFT JOIN i1 ON r.k = i1.k GROUP BY 1", items=True,
)
add(
    "sheet_receipts",
    lambda r: A.successful(r).select("file_name", "merchant_name", "merchant_address", "merchant_phone", F.col("date").cast("string").alias("date"), "time", "subtotal_c", "tax_c", "tip_c", "total_c", "payment_method", "card_last_four", "receipt_number", "ocr_confidence"),
    "SELECT file_name, merchant_name, merchant_address, merchant_phone, dt::VARCHAR AS date, tm AS time, subtotal_c, tax_c, tip_c, total_c, payment_method, card_last_four, receipt_number, ocr_confidence FROM r WHERE success",
)
