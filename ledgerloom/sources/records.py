"""Purchase records from relational tables: orders are records, line items their items.

Amounts are derived in whole cents, so that every engine gets the same ones. ``RECORDS_SQL`` and
``ITEMS_SQL`` are the same derivations in SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schemas import ITEMS, MONEY

METHODS = ("Visa", "Mastercard", "Cash", "Debit", None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") / 100).cast(MONEY)


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each item: k, pos, description, quantity, unit_c, line_c."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_name")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    line_c = F.floor(cents / 50)
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("p_name").alias("description"), F.col("l_quantity").alias("quantity"),
        F.floor(line_c / F.col("l_quantity").cast("bigint")).alias("unit_c"), line_c.alias("line_c"),
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("l_linenumber", "l_partkey", "l_suppkey", "quantity", "l_extendedprice")
    rows = item_rows(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct(*order, "description", "unit_c", "line_c"))).alias("rows"))
    made = F.transform(
        "rows",
        lambda x: F.struct(
            x["description"].alias("description"), x["quantity"].alias("quantity"), (x["unit_c"].cast("decimal(18,0)") / 100).cast("decimal(18,6)").alias("unit_price"),
            money(x["line_c"]).alias("total_price"), F.lit(0.8).alias("confidence"),
        ),
    )
    return rows.select(F.col("k").alias("item_k"), made.alias("items"))


def records(spark: SparkSession, sf_dir: str, items: bool = False, text: bool = False) -> DataFrame:
    """Typed records. Items and text are only derived when asked for: they need another join."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    base = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: a fixed table of 25
    total = F.floor(F.round(F.col("o_totalprice") * 100).cast("bigint") / 50) * F.when(k % 211 == 0, 3).otherwise(1)
    base = base.select("*", k.alias("k"), total.alias("total_c")).withColumn("tax_c", F.floor(F.col("total_c") * (k % 9) / 100))
    base = base.withColumn("subtotal_c", F.col("total_c") - F.col("tax_c") + F.when(k % 5 == 0, 5).otherwise(0))
    base = base.withColumn("tip_c", F.when(k % 4 == 0, F.floor(F.col("total_c") / 10)))
    method = F.get(F.array(*map(F.lit, METHODS)), (k % 5).cast("int"))
    out = base.select(
        "k",
        F.concat(F.lit("f"), k.cast("string")).alias("file_id"),
        F.concat(F.lit("f"), k.cast("string"), F.lit(".jpg")).alias("file_name"),
        F.when(k % 97 != 0, F.col("n_name")).alias("merchant_name"),
        F.when(k % 11 != 0, F.concat((k % 900 + 100).cast("string"), F.lit(" Main St"))).alias("merchant_address"),
        F.when(k % 7 != 0, F.concat(F.lit("5"), F.lpad((k % 1000000000).cast("string"), 9, "0"))).alias("merchant_phone"),
        F.when(k % 53 != 0, F.to_date("o_orderdate")).alias("date"),
        F.when(k % 13 != 0, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))).alias("time"),
        "subtotal_c", "tax_c", "tip_c", "total_c",
        *(money(F.col(c)).alias(n) for c, n in (("subtotal_c", "subtotal"), ("tax_c", "tax_amount"), ("tip_c", "tip_amount"), ("total_c", "total_amount"))),
        method.alias("payment_method"),
        F.when((k % 5).isin(0, 1, 3), F.lpad((k % 10000).cast("string"), 4, "0")).alias("card_last_four"),
        F.concat(F.lit("R"), k.cast("string")).alias("receipt_number"),
        F.when(F.col("o_orderstatus") == "O", "google_vision").when(F.col("o_orderstatus") == "F", "document_detection").otherwise("tesseract").alias("ocr_method"),
        (k % 101 / F.lit(100.0)).alias("ocr_confidence"),
        (k % 50 / F.lit(10.0)).alias("processing_time"),
        (k * 7 % 101 / F.lit(100.0)).alias("confidence_score"),
        (k % 29 != 0).alias("success"),
    )
    if items or text:
        found = _items(spark, sf_dir)
        out = out.join(found, F.col("k") == F.col("item_k"), "left").drop("item_k").withColumn("items", F.coalesce("items", F.array().cast(ITEMS)))
    if text:
        out = out.withColumn("raw_text", render())
    return out


def render() -> Column:
    """The text of a record, as a scanner would give it."""
    amount = lambda label, c: F.concat(F.lit(f"{label}: $"), F.col(c).cast("string"))
    date = F.when(F.col("k") % 2 == 0, F.date_format("date", "MM/dd/yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    items = F.array_join(F.transform("items", lambda x: F.concat(x["description"], F.lit(" "), x["total_price"].cast("string"))), "\n")
    card = F.concat_ws(" ending in ", "payment_method", "card_last_four")
    return F.concat_ws(
        "\n",
        "merchant_name", "merchant_address", "merchant_phone", date, "time", F.when(F.size("items") > 0, items),
        amount("Subtotal", "subtotal"), amount("Tax", "tax_amount"), amount("Tip", "tip_amount"), amount("Total", "total_amount"),
        F.when(F.col("payment_method").isNotNull(), card), F.concat(F.lit("Order #"), F.col("receipt_number")),
    )


RECORDS_SQL = """
r0 AS (
  SELECT o_orderkey AS k, n_name, o_orderdate, o_orderstatus,
    (round(o_totalprice * 100)::BIGINT // 50) * (CASE WHEN o_orderkey % 211 = 0 THEN 3 ELSE 1 END) AS total_c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (
  SELECT k, 'f' || k AS file_id, 'f' || k || '.jpg' AS file_name,
    CASE WHEN k % 97 <> 0 THEN n_name END AS merchant_name,
    CASE WHEN k % 11 <> 0 THEN (k % 900 + 100) || ' Main St' END AS merchant_address,
    CASE WHEN k % 7 <> 0 THEN '5' || lpad((k % 1000000000)::VARCHAR, 9, '0') END AS merchant_phone,
    CASE WHEN k % 53 <> 0 THEN o_orderdate::DATE END AS dt,
    CASE WHEN k % 13 <> 0 THEN lpad((k % 24)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') END AS tm,
    total_c, (total_c * (k % 9)) // 100 AS tax_c,
    total_c - (total_c * (k % 9)) // 100 + (CASE WHEN k % 5 = 0 THEN 5 ELSE 0 END) AS subtotal_c,
    CASE WHEN k % 4 = 0 THEN total_c // 10 END AS tip_c,
    ['Visa', 'Mastercard', 'Cash', 'Debit', NULL][k % 5 + 1] AS payment_method,
    CASE WHEN k % 5 IN (0, 1, 3) THEN lpad((k % 10000)::VARCHAR, 4, '0') END AS card_last_four,
    'R' || k AS receipt_number,
    CASE o_orderstatus WHEN 'O' THEN 'google_vision' WHEN 'F' THEN 'document_detection' ELSE 'tesseract' END AS ocr_method,
    (k % 101) / 100.0::DOUBLE AS ocr_confidence, (k % 50) / 10.0::DOUBLE AS processing_time,
    (k * 7 % 101) / 100.0::DOUBLE AS confidence_score, k % 29 <> 0 AS success
  FROM r0)"""

ITEMS_SQL = """
i0 AS (
  SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_name AS description, l_quantity AS quantity,
    round(l_extendedprice * 100)::BIGINT // 50 AS line_c, (round(l_extendedprice * 100)::BIGINT // 50) // l_quantity::BIGINT AS unit_c
  FROM lineitem JOIN part ON l_partkey = p_partkey),
i1 AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, quantity, l_extendedprice, description, unit_c, line_c) AS pos FROM i0)"""


def money_sql(cents: str) -> str:
    return f"({cents}) // 100 || '.' || lpad((({cents}) % 100)::VARCHAR, 2, '0')"


TEXT_SQL = f"""
t AS (
  SELECT r.*, concat_ws(chr(10), merchant_name, merchant_address, merchant_phone,
    CASE WHEN r.k % 2 = 0 THEN strftime(dt, '%m/%d/%Y') ELSE strftime(dt, '%Y-%m-%d') END, tm, i2.txt,
    'Subtotal: $' || {money_sql("subtotal_c")}, 'Tax: $' || {money_sql("tax_c")}, 'Tip: $' || {money_sql("tip_c")}, 'Total: $' || {money_sql("total_c")},
    CASE WHEN payment_method IS NOT NULL THEN concat_ws(' ending in ', payment_method, card_last_four) END, 'Order #' || receipt_number) AS raw_text
  FROM r LEFT JOIN (SELECT k, string_agg(description || ' ' || {money_sql("line_c")}, chr(10) ORDER BY pos) AS txt FROM i1 GROUP BY k) i2 ON r.k = i2.k)"""


def sql(body: str, items: bool = False, text: bool = False) -> str:
    parts = [RECORDS_SQL] + ([ITEMS_SQL] if items or text else []) + ([TEXT_SQL] if text else [])
    head = "WITH " + ",".join(parts)
    body = body.strip()
    return f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head} {body}"
