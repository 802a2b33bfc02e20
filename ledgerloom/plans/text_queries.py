"""Queries of text extraction and merchant templates: (Spark plan, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import merchants as M
from ledgerloom.functions import text as T
from ledgerloom.plans.scoring_queries import _CONS, _FACTS, _PTS
from ledgerloom.sources.records import money_sql, read, records, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, plan, text: str | None, items: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(records(spark, sf_dir, items=True, text=True))
    if text:
        SQL[name] = sql(text, items=True, text=True)


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _first(pattern: str, group: int = 0) -> str:
    p = f"(?i){_q(pattern)}"
    return f"CASE WHEN regexp_matches(raw_text, '{p}') THEN regexp_extract(raw_text, '{p}', {group}) END"


_CLEAN = r"trim(regexp_replace(replace(regexp_replace({0}, '\s+', ' ', 'g'), '＄', '$'), '[^\x20-\x7E\n]', '', 'g'))"
QUERIES["clean_text"] = lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("clean_md5"))
SQL["clean_text"] = f"SELECT doc_id, md5({_CLEAN.format('text')}) AS clean_md5 FROM documents"
_t = lambda: F.col("raw_text")
_C = _CLEAN.format("raw_text")
_ADDRESS = " OR ".join(f"regexp_matches({_C}, '(?i){_q(p)}')" for p in T.ADDRESSES)
_short = lambda: F.when(F.col("k") % 3 == 0, _t()).when(F.col("k") % 3 == 1, F.concat_ws(" ", "merchant_name", "payment_method")).otherwise(F.upper("merchant_name"))
_SHORT = "CASE k % 3 WHEN 0 THEN raw_text WHEN 1 THEN concat_ws(' ', merchant_name, payment_method) ELSE upper(merchant_name) END"
_fields = lambda r, **cols: r.select("file_id", *(c.alias(n) for n, c in cols.items()))
add(
    "extract_merchant", lambda r: _fields(r, merchant=T.merchant_name(_short())),
    f"""WITH x AS (SELECT file_id, {_CLEAN.format(f"({_SHORT})")} AS raw_text FROM t)
    SELECT file_id, CASE WHEN length(raw_text) > 3 AND NOT ({_ADDRESS.replace(_C, 'raw_text')}) AND NOT regexp_matches(raw_text, '{T.PHONE}')
      AND (length(raw_text) > 8 OR NOT (upper(raw_text) = raw_text AND lower(raw_text) <> raw_text)) THEN raw_text END AS merchant FROM x""",
)
add("extract_address", lambda r: _fields(r, address=T.merchant_address(_t())), f"SELECT file_id, CASE WHEN {_ADDRESS} THEN {_C} END AS address FROM t")
add("extract_phone", lambda r: _fields(r, phone=T.phone(_t())), f"SELECT file_id, {_first(T.PHONE)} AS phone FROM t")
add(
    "extract_date", lambda r: _fields(r, date=T.date(_t()).cast("string")),
    f"""WITH m AS (SELECT file_id, {_first(T.DATES[0])} AS a, {_first(T.DATES[1])} AS b FROM t),
    p AS (SELECT *, string_split(replace(a, '-', '/'), '/') AS x, string_split(replace(b, '-', '/'), '/') AS y FROM m)
    SELECT file_id, coalesce(
      try_cast((CASE WHEN length(x[3]) = 4 THEN x[3] WHEN length(x[3]) = 2 THEN (CASE WHEN x[3]::INT >= 69 THEN '19' ELSE '20' END) || x[3] END) || '-' || lpad(x[1], 2, '0') || '-' || lpad(x[2], 2, '0') AS DATE),
      try_cast(y[1] || '-' || lpad(y[2], 2, '0') || '-' || lpad(y[3], 2, '0') AS DATE))::VARCHAR AS date FROM p""",
)
add("extract_time", lambda r: _fields(r, time=T.time(_t())), rf"SELECT file_id, regexp_replace({_first(T.TIME)}, '\s+$', '') AS time FROM t")
_money = lambda c: c.cast("string")
add(
    "extract_amounts",
    lambda r: _fields(r, total=_money(T.amount(_t(), T.TOTAL)), subtotal=_money(T.amount(_t(), T.SUBTOTAL)), tax=_money(T.amount(_t(), T.TAX)), tip=_money(T.amount(_t(), T.TIP))),
    f"SELECT file_id, {_first(T.TOTAL, 1)} AS total, {_first(T.SUBTOTAL, 1)} AS subtotal, {_first(T.TAX, 1)} AS tax, {_first(T.TIP, 1)} AS tip FROM t",
)
add(
    "extract_payment", lambda r: _fields(r, method=T.payment_method(_t()), last4=T.card_last_four(_t())),
    f"SELECT file_id, split_part({_first(T.PAYMENT)}, ' ', 1) AS method, nullif({_first(T.PAYMENT, 1)}, '') AS last4 FROM t",
)
add("extract_refno", lambda r: _fields(r, number=T.receipt_number(_t())), f"SELECT file_id, coalesce({_first(T.NUMBERS[0], 1)}, {_first(T.NUMBERS[1], 1)}) AS number FROM t")


def _exploded(r: DataFrame, items: Column) -> DataFrame:
    x = r.select("file_id", F.posexplode(items).alias("pos", "x"))
    return x.select("file_id", "pos", F.col("x.description").alias("description"), F.col("x.quantity").alias("quantity"), F.col("x.total_price").cast("string").alias("price"), F.col("x.confidence").alias("confidence"))


_LINES = r"""l AS (SELECT file_id, k, unnest(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 5)) AS line,
  generate_subscripts(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 5), 1) AS n FROM t)"""
add(
    "extract_items", lambda r: _exploded(r, T.items(_t())),
    f"""WITH {_LINES}, m AS (SELECT * FROM l WHERE regexp_matches(line, '{T.ITEM}'))
    SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY n) - 1)::INT AS pos, regexp_extract(line, '{T.ITEM}', 1) AS description, NULL::DOUBLE AS quantity,
      regexp_extract(line, '{T.ITEM}', 2) AS price, 0.8::DOUBLE AS confidence FROM m""",
)
_kept = ("file_id", "raw_text", "ocr_confidence")
_all = lambda r: T.extract(r.select(*_kept))
_scored = lambda r: _all(r).withColumn("confidence_score", F.round("confidence_score", 6))
_EXTRACTED = f"""
    d AS (SELECT k, {_first(T.DATES[0])} AS a, {_first(T.DATES[1])} AS b FROM t),
    dd AS (SELECT k, string_split(replace(a, '-', '/'), '/') AS x, string_split(replace(b, '-', '/'), '/') AS y FROM d),
    cl AS (SELECT *, {_C} AS cl FROM t),
    p AS (SELECT c.k, file_id, raw_text, ocr_confidence, CASE WHEN length(cl) > 3 AND NOT ({_ADDRESS.replace(_C, 'cl')}) AND NOT regexp_matches(cl, '{T.PHONE}') AND (length(cl) > 8 OR NOT (upper(cl) = cl AND lower(cl) <> cl)) THEN cl END AS merchant_name,
      CASE WHEN {_ADDRESS.replace(_C, 'cl')} THEN cl END AS merchant_address, {_first(T.PHONE)} AS merchant_phone,
      coalesce(try_cast((CASE WHEN length(x[3]) = 4 THEN x[3] WHEN length(x[3]) = 2 THEN (CASE WHEN x[3]::INT >= 69 THEN '19' ELSE '20' END) || x[3] END) || '-' || lpad(x[1], 2, '0') || '-' || lpad(x[2], 2, '0') AS DATE),
        try_cast(y[1] || '-' || lpad(y[2], 2, '0') || '-' || lpad(y[3], 2, '0') AS DATE)) AS dt, regexp_replace({_first(T.TIME)}, '\\s+$', '') AS tm,
      {_first(T.TOTAL, 1)} AS total_amount, {_first(T.SUBTOTAL, 1)} AS subtotal, {_first(T.TAX, 1)} AS tax_amount, {_first(T.TIP, 1)} AS tip_amount,
      split_part({_first(T.PAYMENT)}, ' ', 1) AS payment_method, nullif({_first(T.PAYMENT, 1)}, '') AS card_last_four, coalesce({_first(T.NUMBERS[0], 1)}, {_first(T.NUMBERS[1], 1)}) AS receipt_number FROM cl c JOIN dd ON dd.k = c.k),
    {_LINES},
    pi AS (SELECT k, n, regexp_extract(line, '{T.ITEM}', 1) AS description, NULL::DOUBLE AS quantity, NULL::DOUBLE AS unit_c, replace(regexp_extract(line, '{T.ITEM}', 2), '.', '')::BIGINT AS line_c, regexp_extract(line, '{T.ITEM}', 2) AS price FROM l WHERE regexp_matches(line, '{T.ITEM}')),
    pc AS (SELECT *, {', '.join(f"coalesce(replace({c}, '.', '')::BIGINT, 0) AS {n}" for c, n in (('total_amount', 'total_c'), ('subtotal', 'subtotal_c'), ('tax_amount', 'tax_c'), ('tip_amount', 'tip_c')))} FROM p),
    {_FACTS.format(base="pc").replace("FROM i1", "FROM pi")},
    g AS (SELECT *, round(ocr_confidence * 0.4::DOUBLE + {_PTS} / 8.0::DOUBLE * 0.3::DOUBLE + {_CONS} * 0.2::DOUBLE
      + least(1.0, 0.5 + CASE WHEN length(merchant_name) > 3 THEN 0.2 ELSE 0 END + CASE WHEN has_date THEN 0.2 ELSE 0 END + CASE WHEN has_total THEN 0.1 ELSE 0 END)::DOUBLE * 0.1::DOUBLE, 6) AS confidence_score FROM f)"""
_amounts = ", ".join(f"{c}::DECIMAL(18,2) AS {c}" for c in ("total_amount", "subtotal", "tax_amount", "tip_amount"))
add(
    "extract_all", lambda r: _scored(r).drop("raw_text").withColumn("items", F.size("items")),
    f"WITH {_EXTRACTED} SELECT file_id, ocr_confidence, merchant_name, merchant_address, merchant_phone, dt AS date, tm AS time, {_amounts}, payment_method, card_last_four, receipt_number, n_items::INT AS items, confidence_score FROM g",
)
add(
    "to_json_record", lambda r: _scored(r).select("file_id", F.to_json(F.struct("merchant_phone", "date", "time", "total_amount", "items", "confidence_score")).alias("record")),
    f"""WITH {_EXTRACTED}, w AS (SELECT k, string_agg('{{"description":"' || description || '","total_price":' || price || ',"confidence":0.8}}', ',' ORDER BY n) AS told FROM pi GROUP BY k)
    SELECT file_id, '{{' || concat_ws(',', '"merchant_phone":"' || replace(merchant_phone, chr(10), '\\n') || '"', '"date":"' || dt::VARCHAR || '"', '"time":"' || tm || '"', '"total_amount":' || total_amount,
      '"items":[' || coalesce(told, '') || ']', '"confidence_score":' || confidence_score::VARCHAR) || '}}' AS record FROM g LEFT JOIN w ON w.k = g.k""",
)

# Texts that look like those of merchants with a template.
_HEADS = ("WALMART Supercenter", "Target store", "Costco Wholesale", "Kroger", "Pizza Palace", "Corner shop")


def _template_text() -> Column:
    kind, price = F.col("k") % 6, lambda x: x["total_price"].cast("string")
    line = lambda x: (
        F.when(kind == 0, F.concat(F.upper(x["description"]), F.lit(" "), price(x), F.lit(" T")))
        .when(kind == 1, F.concat(x["description"], F.lit(" 123-45-6789 "), price(x), F.lit(" N")))
        .when(kind == 2, F.concat(x["quantity"].cast("int").cast("string"), F.lit(" "), x["description"], F.lit(" "), price(x)))
        .when(kind == 3, F.concat(x["description"], F.lit(" "), price(x), F.lit(" F")))
        .when(kind == 4, F.concat(x["quantity"].cast("int").cast("string"), F.lit(" x "), x["description"], F.lit(" "), price(x)))
        .otherwise(F.concat(F.lit("2 @ $1.50 = $3.00 "), x["description"]))
    )
    head = F.get(F.array(*map(F.lit, _HEADS)), kind.cast("int"))
    end = F.concat(F.lit("TAX "), F.col("tax_amount").cast("string"), F.lit("\nTIP "), F.coalesce(F.col("tip_amount").cast("string"), F.lit("none")), F.lit("\nTOTAL "), F.col("total_amount").cast("string"))
    return F.concat_ws("\n", head, F.when(F.size("items") > 0, F.array_join(F.transform("items", line), "\n")), end)


_TEMPLATE = f"""
  b AS (SELECT k, string_agg(CASE k % 6 WHEN 0 THEN upper(description) || ' ' || {money_sql('line_c')} || ' T' WHEN 1 THEN description || ' 123-45-6789 ' || {money_sql('line_c')} || ' N'
    WHEN 2 THEN quantity::INT || ' ' || description || ' ' || {money_sql('line_c')} WHEN 3 THEN description || ' ' || {money_sql('line_c')} || ' F'
    WHEN 4 THEN quantity::INT || ' x ' || description || ' ' || {money_sql('line_c')} ELSE '2 @ $1.50 = $3.00 ' || description END, chr(10) ORDER BY pos) AS body FROM i1 GROUP BY k),
  m AS (SELECT r.k, file_id, tax_c, tip_c, total_c, CASE r.k % 6 WHEN 0 THEN 'walmart' WHEN 1 THEN 'target' WHEN 2 THEN 'costco' WHEN 3 THEN 'grocery' WHEN 4 THEN 'restaurant' END AS kind,
    concat_ws(chr(10), {list(_HEADS)}[r.k % 6 + 1], body,
    'TAX ' || {money_sql('tax_c')}, 'TIP ' || coalesce({money_sql('tip_c')}, 'none'), 'TOTAL ' || {money_sql('total_c')}) AS txt FROM r LEFT JOIN b ON r.k = b.k)"""
_with_text = lambda r: r.withColumn("raw_text", _template_text())
add("merchant_type", lambda r: _fields(_with_text(r), merchant_type=M.merchant_type(_t())), f"WITH {_TEMPLATE} SELECT file_id, kind AS merchant_type FROM m")


def _template_totals(r: DataFrame) -> DataFrame:
    x = _with_text(r).select("file_id", "raw_text", "items", *(T.amount(_t(), p).alias(c) for c, p in (("total_amount", T.TOTAL), ("tax_amount", T.TAX), ("tip_amount", T.TIP))))
    return M.apply_template(x).select("file_id", *(F.col(c).cast("string").alias(c) for c in M.AMOUNTS))


add(
    "template_totals", _template_totals,
    f"WITH {_TEMPLATE} SELECT file_id, {money_sql('total_c')} AS total_amount, {money_sql('tax_c')} AS tax_amount, {money_sql('tip_c')} AS tip_amount FROM m",
)


def _template_items(r: DataFrame) -> DataFrame:
    x = _with_text(r).withColumn("merchant_type", M.merchant_type(_t()))
    x = x.select("file_id", F.explode(M.template_items(_t(), F.col("merchant_type"))).alias("x"))
    return x.select("file_id", F.col("x.description").alias("description"), F.col("x.quantity").alias("quantity"), F.col("x.unit_price").cast("double").alias("unit_price"), F.col("x.total_price").cast("string").alias("price"))


def _template_sql() -> str:
    parts = []
    for kind, patterns in M.ITEMS_OF.items():
        for pattern, qty, desc, price, _ in patterns:
            p = f"(?m){_q(pattern)}"
            got = lambda g: f"unnest(regexp_extract_all(txt, '{p}', {g}))"  # noqa: E731, B023
            body = f"SELECT file_id, kind, {got(desc)} AS d, {got(qty) if qty else 'NULL'} AS q, {got(price)} AS p FROM m WHERE kind = '{kind}'"
            parts.append(f"SELECT * FROM ({body})" + (r" WHERE NOT regexp_matches(d, '^\d+$')" if kind in ("grocery", "restaurant") and not qty else ""))
    return " UNION ALL ".join(parts)


add(
    "template_items", _template_items,
    rf"""WITH {_TEMPLATE}, e AS ({_template_sql()})
    SELECT file_id, regexp_replace(d, '^\s+|\s+$', '', 'g') AS description, q::DOUBLE AS quantity, CASE WHEN q IS NOT NULL THEN ((replace(p, '.', '')::BIGINT * 20000 + q::BIGINT) // (2 * q::BIGINT)) / 1000000.0::DOUBLE END AS unit_price, p AS price FROM e""",
)
# Items' own lines are held; of the others only a tip's is an item, as its name isn't among those that are none.
add(
    "enhance_items", lambda r: _exploded(_with_text(r), M.enhance(_t(), F.col("items"))),
    f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY k, lower(trim(description)) ORDER BY pos) AS i FROM i1),
    y AS (SELECT k, description, quantity, line_c, row_number() OVER (PARTITION BY k ORDER BY pos) AS n FROM x WHERE i = 1), c AS (SELECT k, count(*) AS n FROM y GROUP BY k)
    SELECT 'f' || k AS file_id, (n - 1)::INT AS pos, description, quantity::DOUBLE AS quantity, {money_sql('line_c')} AS price, 0.8::DOUBLE AS confidence FROM y
    UNION ALL SELECT file_id, coalesce(n, 0)::INT, 'TIP', NULL, {money_sql('tip_c')}, 0.7 FROM r LEFT JOIN c ON c.k = r.k WHERE tip_c IS NOT NULL""",
)
_extra_line = lambda: F.when(F.col("pos") % 3 == 0, F.concat(F.upper("description"), F.lit(" $"), F.col("price"))).when(F.col("pos") % 3 == 1, F.concat("description", F.lit(" "), F.col("price"))).otherwise(
    F.concat(F.lit("3 @ $"), F.col("price"), F.lit(" = $"), F.when(F.col("pos") % 2 == 0, (F.col("price").cast("decimal(18,2)") * 3).cast("decimal(18,2)").cast("string")).otherwise(F.col("price")))
)


def _extra(r: DataFrame) -> DataFrame:
    x = r.select("file_id", F.posexplode("items").alias("pos", "x")).select("file_id", "pos", F.col("x.description").alias("description"), F.col("x.total_price").cast("string").alias("price"))
    x = x.select("file_id", "pos", M.extra_item(_extra_line()).alias("x")).where("x IS NOT NULL")
    return x.select("file_id", "pos", F.col("x.description").alias("description"), F.col("x.quantity").alias("quantity"), F.col("x.total_price").cast("string").alias("price"), F.col("x.confidence").alias("confidence"))


_BAD = "|".join(f"(?:{_q(p)})" for p in M.NO_ITEMS)
_VALID = "(NOT regexp_matches(lower({0}), '" + _BAD.replace("{", "{{").replace("}", "}}") + "') AND length({0}) BETWEEN 3 AND 50 AND regexp_matches({0}, '[a-zA-Z]'))"
add(
    "extra_items", _extra,
    rf"""WITH x AS (SELECT 'f' || k AS file_id, (pos - 1)::INT AS pos, description AS d, line_c FROM i1), y AS (
      SELECT file_id, pos, upper(d) AS description, NULL::DOUBLE AS quantity, {money_sql('line_c')} AS price, 0.7::DOUBLE AS confidence FROM x WHERE pos % 3 = 0 AND {_VALID.format('upper(d)')} AND regexp_matches(d, '^[A-Za-z][A-Za-z\s\-&''.]+$')
      UNION ALL SELECT file_id, pos, d, NULL, {money_sql('line_c')}, 0.7 FROM x WHERE pos % 3 = 1 AND {_VALID.format('d')} AND regexp_matches(d, '^[A-Za-z][A-Za-z\s\-&''.]+$')
      UNION ALL SELECT file_id, pos, 'Item (qty: 3.0)', 3.0, {money_sql('line_c * 3')}, 0.8 FROM x WHERE pos % 3 = 2 AND pos % 2 = 0
      UNION ALL SELECT file_id, pos, 'Item (qty: 3.0)', 3.0, {money_sql('line_c')}, 0.8 FROM x WHERE pos % 3 = 2 AND pos % 2 = 1 AND line_c * 2 < 2)
    SELECT * FROM y""",
)
add(
    "valid_desc", lambda r: r.select("file_id", F.posexplode(T.lines_of(_t())).alias("pos", "line")).select("file_id", "pos", M.valid_description(F.col("line")).alias("valid")),
    f"WITH {_LINES} SELECT file_id, (n - 1)::INT AS pos, {_VALID.format('line')} AS valid FROM l",
)
add(
    "dedup_items", lambda r: r.select("file_id", F.explode(M.dedup(F.col("items"))).alias("x")).select("file_id", F.col("x.description").alias("description"), F.col("x.total_price").cast("string").alias("price")),
    f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY k, lower(trim(description)) ORDER BY pos) AS i FROM i1) SELECT 'f' || k AS file_id, description, {money_sql('line_c')} AS price FROM x WHERE i = 1",
)
_WORDS = ("Fresh MILK", "sparkling water", "dish soap", "vitamin c", "t-shirt", "phone cable", "gadget", "steak")
_CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(d, '{w}')" for w in words) + f" THEN '{name}'" for name, words in M.CATEGORIES.items()) + " END"
QUERIES["item_category"] = lambda spark, sf_dir: read(spark, sf_dir, "part").select(
    "p_partkey", M.category(F.concat("p_name", F.lit(" "), F.get(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % 8).cast("int")))).alias("category")
)
SQL["item_category"] = f"WITH x AS (SELECT p_partkey, lower(p_name || ' ' || {list(_WORDS)}[p_partkey % 8 + 1]) AS d FROM part) SELECT p_partkey, {_CATEGORY} AS category FROM x"
#: As ``_EXTRACTED``, over the texts of templates and without rounding.
_TEMPLATED = _EXTRACTED.replace("round(ocr_confidence", "(ocr_confidence").replace("* 0.1::DOUBLE, 6) AS confidence_score", "* 0.1::DOUBLE) AS confidence_score")
_parsed = lambda r: M.parse(T.extract(_with_text(r).select(*_kept)))
QUERIES["parse_advanced"] = lambda spark, sf_dir: _parsed(records(spark, sf_dir, items=True, text=True)).select(
    "file_id", "merchant_type", F.size("items").alias("n_items"), F.col("total_amount").cast("string").alias("total"), F.round("confidence_score", 6).alias("score")
)
# Template items take the place of those found; a tip's line adds one where nothing on it is an item yet. These texts have no subtotal, so sums never agree.
SQL["parse_advanced"] = sql(
    rf"""WITH {_TEMPLATE}, t AS (SELECT m.k, m.file_id, txt AS raw_text, ocr_confidence FROM m JOIN r ON r.k = m.k), {_TEMPLATED},
    e AS ({_template_sql()}), te AS (SELECT file_id, lower(regexp_replace(d, '^\s+|\s+$', '', 'g')) AS d FROM e),
    bi AS (SELECT file_id, lower(trim(description)) AS d FROM pi JOIN t ON t.k = pi.k),
    al AS (SELECT * FROM te UNION SELECT * FROM bi WHERE file_id NOT IN (SELECT file_id FROM te)),
    ct AS (SELECT file_id, count(*) AS n, bool_or(d = 'tip') AS tipped FROM al GROUP BY 1),
    z AS (SELECT g.*, m.kind, m.total_c AS whole, (coalesce(n, 0) + CASE WHEN m.tip_c IS NOT NULL AND NOT coalesce(tipped, false) THEN 1 ELSE 0 END)::INT AS found FROM g JOIN m ON m.k = g.k LEFT JOIN ct ON ct.file_id = g.file_id)
    SELECT file_id, kind AS merchant_type, found AS n_items, {money_sql('whole')} AS total, round(least(1.0::DOUBLE, confidence_score * 0.4::DOUBLE + 0.2::DOUBLE * has_name::INT
      + (0.2::DOUBLE * has_date::INT + 0.3::DOUBLE * has_total::INT + 0.3::DOUBLE * (found > 0)::INT + 0.1::DOUBLE * has_tax::INT + 0.1::DOUBLE * has_name::INT) * 0.3::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE), 6) AS score FROM z""", items=True,
)
