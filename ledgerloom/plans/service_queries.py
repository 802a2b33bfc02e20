"""Queries of library scans, record assembly, sinks and packages: (Spark plan, DuckDB SQL)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import cluster
from ledgerloom.config import Settings
from ledgerloom.functions import validation as V
from ledgerloom.operators import analytics as A
from ledgerloom.operators import ocr, process
from ledgerloom.plans import export, sinks
from ledgerloom.plans import picture_queries
from ledgerloom.plans.cache_queries import _WORDS, _words
from ledgerloom.plans.export_queries import _usd
from ledgerloom.plans.scoring_queries import _CONS, _FACTS, _ISSUES, _OVERALL, _PTS, AS_OF, _facts, _joined
from ledgerloom.plans.text_queries import _ADDRESS, _C, _CLEAN, _LINES, _first
from ledgerloom.functions import text as T
from ledgerloom.sources import files, library, listing
from ledgerloom.sources.records import money_sql, read, records, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = dt.datetime(2024, 3, 1)


# Files in 25 folders, also seen as items of 25 albums; images have photo metadata, but for some.
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("file_id")
    photo = F.when(F.col("mime").startswith("image/") & (i % 11 != 0), F.struct((i % 4000).alias("width"), (i % 3000).alias("height")))
    more = {"parent": i % 25, "album_id": i % 25, "trashed": F.when(i % 5 != 0, i % 23 == 0), "photo": photo}
    status = F.when(i % 9 == 0, "error").when(i % 4 == 0, "skipped").otherwise("processed")
    return files.from_documents(spark, sf_dir).withColumns(more | {"status": status, "cache_path": F.when(i % 6 != 0, F.concat(F.lit("cache/"), "digest"))})


_FILES = files.FILES_SQL + """, cc AS (SELECT *, file_id % 25 AS parent, file_id % 25 AS album_id, file_id % 5 <> 0 AND file_id % 23 = 0 AS trashed, mime LIKE 'image/%' AND file_id % 11 <> 0 AS is_photo,
  CASE WHEN file_id % 9 = 0 THEN 'error' WHEN file_id % 4 = 0 THEN 'skipped' ELSE 'processed' END AS status, CASE WHEN file_id % 6 <> 0 THEN 'cache/' || digest END AS cache_path FROM c)"""


def scan(name: str, plan, text: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(_files(spark, sf_dir))
    SQL[name] = f"WITH {_FILES} {text}"


_short = ("file_id", "name", "mime")
_ALBUMS = lambda spark, sf_dir: read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("album_id"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("title"))
_TITLE = "CASE WHEN n_nationkey % 7 <> 0 THEN n_name ELSE 'Unknown' END"
scan("scan_folder", lambda c: library.folder_images(c, 3).select(*_short), "SELECT file_id, name, mime FROM cc WHERE mime LIKE 'image/%' AND parent = 3 AND NOT trashed")
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table as a listing of pages, read back through the data source with its filters."""
    path = cluster.new_path(spark, "listing")
    listing.write_pages(_files(spark, sf_dir), path, 500)
    return listing.images_of(listing.listing(spark, path, "file_id long, name string, mime string, size long, trashed boolean, parent long"), 3).select(*_short, "size")


QUERIES["src_images"] = _listed
SQL["src_images"] = f"WITH {_FILES} SELECT file_id, name, mime, size FROM cc WHERE mime LIKE 'image/%' AND parent = 3 AND NOT trashed"
scan("scan_album", lambda c: library.album_items(c, 4).select(*_short), "SELECT file_id, name, mime FROM cc WHERE album_id = 4 AND is_photo")
scan("list_folders", lambda c: library.folders(c).select(*_short), "SELECT file_id, name, mime FROM cc WHERE mime = 'application/folder' AND NOT trashed ORDER BY file_id LIMIT 100")
scan("list_capped", lambda c: library.folders(c).limit(library.SHOWN).select(*_short), "SELECT file_id, name, mime FROM cc WHERE mime = 'application/folder' AND NOT trashed ORDER BY file_id LIMIT 20")
scan("lookup_file", lambda c: library.lookup(c, "file_id", 8).select(*_short), "SELECT file_id, name, mime FROM cc WHERE file_id = 8")
scan("lookup_folder", lambda c: library.lookup(c, "file_id", 6, folder=True).select(*_short).union(library.lookup(c, "file_id", 8, folder=True).select(*_short)), "SELECT file_id, name, mime FROM cc WHERE file_id IN (6, 8) AND mime = 'application/folder'")
scan("media_urls", lambda c: c.where(library.is_photo()).select("file_id", library.media_url(F.col("digest"), 2048).alias("shrunk"), library.media_url(F.col("digest")).alias("whole")), "SELECT file_id, digest || '=w2048-h2048' AS shrunk, digest || '=d' AS whole FROM cc WHERE is_photo")
scan("eligible", lambda c: process.eligible(c).select("file_id", "cache_path"), "SELECT file_id, cache_path FROM cc WHERE status = 'processed' AND cache_path IS NOT NULL")
scan("old_exports", lambda c: library.old_files(c, NOW), f"SELECT count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS bytes, round(coalesce(sum(size), 0)::DOUBLE / 1048576, 2) AS mb FROM cc WHERE cached_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY")
QUERIES["list_albums"] = lambda spark, sf_dir: library.albums(_ALBUMS(spark, sf_dir))
SQL["list_albums"] = f"SELECT n_nationkey::BIGINT AS album_id, {_TITLE} AS title FROM nation"
QUERIES["album_sizes"] = lambda spark, sf_dir: library.album_sizes(_ALBUMS(spark, sf_dir), _files(spark, sf_dir))
SQL["album_sizes"] = f"WITH {_FILES}, n AS (SELECT album_id, count(*) AS n FROM cc WHERE is_photo GROUP BY 1) SELECT n_nationkey::BIGINT AS album_id, {_TITLE} AS title, coalesce(n, 0) AS total_items, coalesce(n, 0) AS image_items FROM nation LEFT JOIN n ON n_nationkey = album_id"

# Engines: what they can do, handwriting, and the way from candidates to records.
_HINT = "en"
QUERIES["handwriting"] = lambda spark, sf_dir: ocr.document_confidence(_words(spark, sf_dir), "k", "paragraph").withColumn("language_hint", F.lit(_HINT))
SQL["handwriting"] = f"WITH {_WORDS}, p AS (SELECT k, paragraph, sum(percent)::DOUBLE / count(*)::DOUBLE AS p FROM w GROUP BY ALL) SELECT k, round(avg(p) / 100, 6) AS confidence, '{_HINT}' AS language_hint FROM p GROUP BY 1"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third record's picture can't be opened where its number is divisible by 17; engines read the same text, or fail."""
    k, r = F.col("k"), records(spark, sf_dir, items=True, text=True)
    share = lambda n: k * n % 101 / F.lit(100.0)
    engines = {"vision": (6, 3), "doc": (7, 5), "tess": (5, 7)}
    cells = [c for e, (skip, n) in engines.items() for c in ((k % skip != 0).alias(f"{e}_ok"), share(n).alias(f"{e}_conf"), F.concat(F.lit(f"{e}\n"), "raw_text").alias(f"{e}_text"))]
    return r.select("k", "file_id", *cells, F.when(k % 17 == 0, "cannot read image").alias("problem"))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engines can do: an engine is there if it has read anything of what it was given."""
    s = Settings()
    seen = _candidates(spark, sf_dir).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("google_vision_available", "vision_ok"), ("tesseract_available", "tess_ok"))))
    return seen.select("*", F.lit(s.confidence_threshold).alias("confidence_threshold"), F.lit(s.max_image_side).alias("max_image_size"), F.lit(",".join(files.IMAGES)).alias("supported_formats"))


QUERIES["engine_status"] = _status
SQL["engine_status"] = f"SELECT coalesce(bool_or(o_orderkey % 6 <> 0), false) AS google_vision_available, coalesce(bool_or(o_orderkey % 5 <> 0), false) AS tesseract_available, 0.8::DOUBLE AS confidence_threshold, 2048 AS max_image_size, '{','.join(files.IMAGES)}' AS supported_formats FROM orders"


_CHOSEN = """WITH x AS (SELECT *, k % 17 = 0 AS bad, k % 6 <> 0 AND k * 3 % 101 >= 80 AS v, k % 7 <> 0 AND k * 5 % 101 >= 80 AS d, k % 5 <> 0 AS s FROM t),
  y AS (SELECT x.* EXCLUDE (raw_text), NOT bad AND (v OR d OR s) AS good, CASE WHEN bad THEN 'none' WHEN v THEN 'google_vision' WHEN d THEN 'document_detection' WHEN s THEN 'tesseract' ELSE 'none' END AS method,
    (CASE WHEN bad THEN 0 WHEN v THEN k * 3 % 101 WHEN d THEN k * 5 % 101 WHEN s THEN k * 7 % 101 ELSE 0 END) / 100.0::DOUBLE AS conf,
    CASE WHEN bad THEN '' WHEN v THEN 'vision' || chr(10) || raw_text WHEN d THEN 'doc' || chr(10) || raw_text WHEN s THEN 'tess' || chr(10) || raw_text ELSE '' END AS raw_text,
    CASE WHEN bad THEN 'cannot read image' WHEN NOT (v OR d OR s) THEN 'All OCR methods failed' END AS error FROM x)"""
#: Pictures in SQL: those that can be loaded, by whether they are there and fit.
PICTURED = f"""FROM (SELECT t.*, CASE WHEN k % 17 = 0 THEN 'cannot read image' WHEN k % 8 % 5 IN (1, 3) AND q.id IS NOT NULL THEN 'ValueError: Could not load image' WHEN q.id IS NULL THEN 'no picture' END AS problem,
    CASE WHEN q.id IS NOT NULL THEN CASE WHEN k % 8 % 5 = 3 THEN {picture_queries.SIDE + 1} WHEN k % 8 % 5 = 1 THEN {picture_queries.SIDE} ELSE (w * {picture_queries.SMALL} // greatest(w, h))::INT END END AS made_width,
    CASE WHEN k % 8 % 5 NOT IN (1, 3) THEN round(b, 5) END AS brightness
  FROM t LEFT JOIN (SELECT vec_id // 64 AS id, count(*) AS h, 64 AS w, avg(list_avg(list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 256) + 128))))) AS b FROM embeddings WHERE len(embedding) = 64 GROUP BY 1) q ON q.id = k % 8) t)"""
_read = ("file_id", "success", "error")
QUERIES["text_only"] = lambda spark, sf_dir: process.text_only(_candidates(spark, sf_dir)).select(*_read, "method", "confidence", F.md5("raw_text").alias("text_md5"))
SQL["text_only"] = sql(f"{_CHOSEN} SELECT file_id, good AS success, error, method, conf AS confidence, md5(raw_text) AS text_md5 FROM y", text=True)


#: Pictures that records share; some can't be loaded, some ids have none.
SHARED = 8


def _pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and what became of their pictures; each picture is worked on once."""
    small = {"resize": {"side": picture_queries.SMALL}, "deskew": {"votes": picture_queries.VOTES}}
    one = process.gated(picture_queries.misfits(spark, sf_dir).where(F.col("picture_id") < SHARED), options=small)
    one = one.select("picture_id", F.col("problem").alias("unread"), "made_width", "failed_step", F.round("quality.brightness", 5).alias("brightness"), F.lit(True).alias("there"))
    rows = _candidates(spark, sf_dir).withColumn("picture_id", F.col("k") % SHARED).join(one, "picture_id", "left")
    return rows.withColumn("problem", F.coalesce("problem", "unread", F.when(F.col("there").isNull(), "no picture")))


_MONEY = ("total_amount", "subtotal", "tax_amount", "tip_amount")
_KEPT = ("merchant_name", "merchant_address", "merchant_phone", "time", "payment_method", "card_last_four", "receipt_number", "is_valid", "made_width", "brightness", "stage", "ocr_method", "ocr_confidence")


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = process.process(_pictured(spark, sf_dir), AS_OF)
    told = F.array_join(F.transform("items", lambda i: F.concat(i["description"], F.lit("="), i["total_price"].cast("string"))), ";")
    scores = [F.round(c, 6).alias(c) for c in ("confidence_score", "validation_score")]
    return x.select(*_read, *_KEPT, F.col("date").cast("string").alias("date"), *(F.col(c).cast("string").alias(c) for c in _MONEY), F.size("items").alias("n_items"), F.md5(told).alias("items_md5"), *scores,
                    F.array_join(F.transform("issues", lambda i: i["type"]), ",").alias("issues"))


QUERIES["process_records"] = _processed
_PHONE = "coalesce(" + " OR ".join(f"regexp_matches(merchant_phone, '{p}')" for p in V.PHONES) + ", false)"
_NAME = "(0.5 * (coalesce(length(merchant_name), 0) >= 3)::INT + 0.3 * (coalesce(length(merchant_name), 0) BETWEEN 3 AND 50)::INT)"
_cents = lambda c: f"coalesce(replace({c}, '.', '')::BIGINT, 0)"
SQL["process_records"] = sql(
    f"""{_CHOSEN.replace("k % 17 = 0 AS bad", "problem IS NOT NULL AS bad").replace("'cannot read image'", "problem").replace("SELECT *, problem", "SELECT t.*, made_width, brightness, problem").replace("FROM t)", PICTURED)},
    e AS (SELECT *, {_CLEAN.format("raw_text")} AS cl FROM y WHERE good),
    d AS (SELECT k, {_first(T.DATES[0])} AS a, {_first(T.DATES[1])} AS b FROM e),
    dd AS (SELECT k, string_split(replace(a, '-', '/'), '/') AS x, string_split(replace(b, '-', '/'), '/') AS y FROM d),
    p AS (SELECT e.k, file_id, raw_text, conf AS ocr_confidence, CASE WHEN length(cl) > 3 AND NOT ({_ADDRESS.replace(_C, 'cl')}) AND NOT regexp_matches(cl, '{T.PHONE}') AND (length(cl) > 8 OR NOT (upper(cl) = cl AND lower(cl) <> cl)) THEN cl END AS merchant_name,
      CASE WHEN {_ADDRESS.replace(_C, 'cl')} THEN cl END AS merchant_address, {_first(T.PHONE)} AS merchant_phone,
      coalesce(try_cast((CASE WHEN length(x[3]) = 4 THEN x[3] WHEN length(x[3]) = 2 THEN (CASE WHEN x[3]::INT >= 69 THEN '19' ELSE '20' END) || x[3] END) || '-' || lpad(x[1], 2, '0') || '-' || lpad(x[2], 2, '0') AS DATE),
        try_cast(y[1] || '-' || lpad(y[2], 2, '0') || '-' || lpad(y[3], 2, '0') AS DATE)) AS dt, regexp_replace({_first(T.TIME)}, '\\s+$', '') AS tm,
      {_first(T.TOTAL, 1)} AS total_amount, {_first(T.SUBTOTAL, 1)} AS subtotal, {_first(T.TAX, 1)} AS tax_amount, {_first(T.TIP, 1)} AS tip_amount,
      split_part({_first(T.PAYMENT)}, ' ', 1) AS payment_method, nullif({_first(T.PAYMENT, 1)}, '') AS card_last_four, coalesce({_first(T.NUMBERS[0], 1)}, {_first(T.NUMBERS[1], 1)}) AS receipt_number FROM e JOIN dd ON dd.k = e.k),
    {_LINES.replace("FROM t)", "FROM p)").replace("l AS", "pl AS")},
    pi AS (SELECT k, n, regexp_extract(line, '{T.ITEM}', 1) AS description, NULL::DOUBLE AS quantity, NULL::DOUBLE AS unit_c, replace(regexp_extract(line, '{T.ITEM}', 2), '.', '')::BIGINT AS line_c, regexp_extract(line, '{T.ITEM}', 2) AS price FROM pl WHERE regexp_matches(line, '{T.ITEM}')),
    pc AS (SELECT *, {_cents('total_amount')} AS total_c, {_cents('subtotal')} AS subtotal_c, {_cents('tax_amount')} AS tax_c, {_cents('tip_amount')} AS tip_c FROM p),
    {_FACTS.format(base="pc").replace("FROM i1", "FROM pi")},
    g AS (SELECT *, ocr_confidence * 0.4::DOUBLE + {_PTS} / 8.0::DOUBLE * 0.3::DOUBLE + {_CONS} * 0.2::DOUBLE
      + least(1.0, 0.5 + CASE WHEN length(merchant_name) > 3 THEN 0.2 ELSE 0 END + CASE WHEN has_date THEN 0.2 ELSE 0 END + CASE WHEN has_total THEN 0.1 ELSE 0 END)::DOUBLE * 0.1::DOUBLE AS confidence_score FROM f),
    v AS (SELECT *, ({_OVERALL.replace("(merchant_phone IS NOT NULL)", _PHONE).replace("0.8 * (coalesce(length(merchant_name), 0) >= 3)::INT", _NAME)}) AS validation_score, {_joined([x for pairs in _ISSUES.values() for x in pairs])} AS issues FROM g),
    w AS (SELECT k, string_agg(description || '=' || price, ';' ORDER BY n) AS told FROM pi GROUP BY k)
    SELECT y.file_id, good AS success, error, v.merchant_name, merchant_address, merchant_phone, tm AS time, payment_method, card_last_four, receipt_number,
      CASE WHEN good THEN round(validation_score, 9) >= 0.6 AND has_total END AS is_valid, made_width, brightness, CASE WHEN problem IS NOT NULL THEN 'load' WHEN NOT good THEN 'recognise' END AS stage, method AS ocr_method, conf AS ocr_confidence,
      dt::VARCHAR AS date, total_amount, subtotal, tax_amount, tip_amount, coalesce(v.n_items, 0)::INT AS n_items, md5(coalesce(told, '')) AS items_md5,
      round(confidence_score, 6) AS confidence_score, round(validation_score, 6) AS validation_score, CASE WHEN good THEN issues END AS issues
    FROM (SELECT k, file_id, good, error, problem, made_width, brightness, method, conf FROM y) y LEFT JOIN v ON v.k = y.k LEFT JOIN w ON w.k = y.k""", text=True,
)
QUERIES["batch_counts"] = lambda spark, sf_dir: process.text_only(_candidates(spark, sf_dir)).groupBy("success", "method", "error").agg(F.count(F.lit(1)).alias("n"))
SQL["batch_counts"] = sql(f"{_CHOSEN} SELECT good AS success, method, error, count(*) AS n FROM y GROUP BY ALL", text=True)

# Sinks.
_checked = lambda spark, sf_dir: V.validate(records(spark, sf_dir, items=True, text=True), AS_OF)
_text = lambda *names: [F.col(n).cast("string").alias(n) for n in names]


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sinks.csv_rows(_checked(spark, sf_dir), texts=True).withColumn("item_unit_price", F.round(F.col("item_unit_price").cast("double"), 2))
    money = ("date", "subtotal", "tax_amount", "tip_amount", "total_amount", "item_total_price")
    return x.withColumns({n: F.col(n).cast("string") for n in money} | {"validation_score": F.round("validation_score", 6)})


QUERIES["csv_export"] = _csv
_GOOD = f"round(({_OVERALL}), 9) >= 0.6 AND has_total"
SQL["csv_export"] = _facts(
    f"""SELECT file_name, merchant_name, merchant_address, merchant_phone, dt::VARCHAR AS date, tm AS time, {money_sql('subtotal_c')} AS subtotal, {money_sql('tax_c')} AS tax_amount, {money_sql('tip_c')} AS tip_amount,
    {money_sql('total_c')} AS total_amount, payment_method, card_last_four, receipt_number, ocr_method, ocr_confidence, confidence_score AS validation_confidence, {_GOOD} AS validation_is_valid,
    round(({_OVERALL}), 6) AS validation_score, raw_text, (pos - 1)::INT AS item_pos, description AS item_description, quantity AS item_quantity, round(unit_c / 100.0::DOUBLE, 2) AS item_unit_price,
    CASE WHEN pos IS NOT NULL THEN {money_sql('line_c')} END AS item_total_price, CASE WHEN pos IS NOT NULL THEN 0.8::DOUBLE END AS item_confidence FROM f LEFT JOIN i1 ON f.k = i1.k WHERE success""", "t",
)
SQL["csv_export"] = sql(SQL["csv_export"], text=True)


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lambda path: F.get_json_object("record", f"$.{path}")
    paths = {"file_name": "file_info.file_name", "id": "file_info.file_id", "method": "ocr_info.method", "merchant": "receipt_data.merchant_name", "date": "receipt_data.date", "phone": "receipt_data.merchant_phone", "valid": "validation.is_valid"}
    numbers = {"processing_time": "file_info.processing_time", "confidence": "ocr_info.confidence", "total": "receipt_data.total_amount", "first_price": "receipt_data.items[0].total_price"}
    return sinks.json_rows(_checked(spark, sf_dir)).select("file_id", *(got(p).alias(n) for n, p in paths.items()), *(got(p).cast("double").alias(n) for n, p in numbers.items()))


QUERIES["json_export"] = _json
SQL["json_export"] = sql(
    _facts(
        f"""SELECT file_id, file_name, file_id AS id, ocr_method AS method, merchant_name AS merchant, dt::VARCHAR AS date, merchant_phone AS phone, CASE WHEN {_GOOD} THEN 'true' ELSE 'false' END AS valid,
    processing_time, ocr_confidence AS confidence, total_c / 100.0::DOUBLE AS total, line_c / 100.0::DOUBLE AS first_price FROM f LEFT JOIN i1 ON f.k = i1.k AND pos = 1 WHERE success""", "t",
    ), text=True,
)


def add(name: str, plan, text: str, items: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(records(spark, sf_dir, items=items))
    SQL[name] = sql(text, items=items)


_UNKNOWN = "CASE WHEN coalesce(merchant_name, '') <> '' THEN merchant_name ELSE 'Unknown' END"
add("json_info", sinks.envelope, "SELECT count_if(success)::BIGINT AS total_receipts, '1.0' AS exporter_version, true AS include_confidence_scores, false AS include_raw_text FROM r", items=False)
add(
    "text_report", sinks.report,
    f"""WITH a AS (SELECT count(*) AS n, count_if(success)::BIGINT AS good, coalesce(sum(total_c) FILTER (success), 0)::BIGINT AS c FROM r),
    m AS (SELECT {_UNKNOWN} AS name, count(*) AS n, sum(total_c)::BIGINT AS c FROM r WHERE success GROUP BY 1), o AS (SELECT ocr_method AS name, count(*) AS n FROM r WHERE success GROUP BY 1),
    n AS (SELECT k, count(*) AS n FROM i1 GROUP BY 1), e AS (SELECT r.*, coalesce(n.n, 0) AS n_items, row_number() OVER (ORDER BY r.k) AS place FROM r LEFT JOIN n ON r.k = n.k WHERE success)
    SELECT 'statistics' AS section, 1::BIGINT AS place, 'Total Receipts Processed: ' || n AS line FROM a UNION ALL SELECT 'statistics', 2, 'Successfully Parsed: ' || good FROM a
    UNION ALL SELECT 'statistics', 3, 'Success Rate: ' || printf('%.1f%%', good::DOUBLE / n::DOUBLE * 100) FROM a UNION ALL SELECT 'statistics', 4, 'Total Amount: $' || {money_sql('c')} FROM a
    UNION ALL SELECT 'merchants', -c, name || ': ' || n || ' receipts, $' || {money_sql('c')} FROM m UNION ALL SELECT 'methods', 0, name || ': ' || n || ' receipts' FROM o
    UNION ALL SELECT 'receipts', place, concat_ws(chr(10), place || '. ' || file_name, '   Merchant: ' || {_UNKNOWN}, '   Date: ' || coalesce(dt::VARCHAR, 'Unknown'), '   Total: $' || {money_sql('total_c')},
      '   Confidence: ' || printf('%.1f%%', confidence_score * 100), '   Items: ' || n_items) FROM e""",
)


def _total_of(name: str) -> str:
    return next(m.name for m in export.TEMPLATES[name].fields if m.source == "amounts.total")


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sinks.many(A.valid(_checked(spark, sf_dir)), sinks.PACKAGE)
    total = F.coalesce(*(F.when(F.col("template") == n, F.col("fields")[_total_of(n)]) for n in sinks.PACKAGE))
    return x.select("template", "file_id", F.size("fields").cast("long").alias("n_fields"), total.alias("total"))


_sizes = {n: len(export.TEMPLATES[n].fields) + len(export.TEMPLATES[n].constants) for n in sinks.PACKAGE}
QUERIES["multi_template"] = _many
_OKV = "success AND confidence_score > 0"
SQL["multi_template"] = sql(" UNION ALL ".join(f"SELECT '{n}' AS template, file_id, {size}::BIGINT AS n_fields, {_usd('total_c')} AS total FROM r WHERE {_OKV}" for n, size in _sizes.items()))
_n_files = sum(len(export.TEMPLATES[n].formats) for n in sinks.PACKAGE)


def _packaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = _checked(spark, sf_dir)
    return df, sinks.write_package(df, cluster.new_path(spark, "package"), "all", codec="zstd")


QUERIES["package_counts"] = lambda spark, sf_dir: sinks.package_counts(*_packaged(spark, sf_dir))
SQL["package_counts"] = sql(f"""WITH n AS (SELECT count_if(success)::BIGINT AS receipts_processed FROM r)
  SELECT receipts_processed, 3::BIGINT AS spreadsheet_files, 4::BIGINT AS report_files, {_n_files}::BIGINT AS template_files, 3::BIGINT AS templates_used, {3 + 4 + _n_files}::BIGINT AS total_files_created FROM n""")
QUERIES["package_files"] = lambda spark, sf_dir: _packaged(spark, sf_dir)[1].select("file", "rows", (F.size("parts") > 0).alias("written"))
_of_template = " UNION ALL ".join(f"SELECT 'templates/{n}.{kind}', count(*) FROM r WHERE {_OKV}" for n in sinks.PACKAGE for kind in export.TEMPLATES[n].formats)
SQL["package_files"] = sql(f"""WITH n AS (SELECT k, count(*) AS n FROM i1 GROUP BY k), f AS (
    SELECT 'spreadsheets/receipts.' || kind AS file, sum(greatest(coalesce(n, 0), 1))::BIGINT AS rows FROM r LEFT JOIN n ON n.k = r.k, (VALUES ('csv'), ('xlsx')) t(kind) WHERE success GROUP BY kind
    UNION ALL SELECT 'spreadsheets/receipts.json', count(*) FROM r WHERE success UNION ALL {_of_template}
    UNION ALL SELECT 'reports/statistics.json', 1 UNION ALL SELECT 'reports/spending_by_merchant.csv', count(DISTINCT {_UNKNOWN}) FROM r WHERE success
    UNION ALL SELECT 'reports/spending_over_time.csv', count(DISTINCT dt) FROM r WHERE success
    UNION ALL SELECT 'reports/summary.txt', 4 + count(DISTINCT {_UNKNOWN}) + count(DISTINCT ocr_method) + count(*) FROM r WHERE success)
  SELECT file, rows, rows > 0 AS written FROM f""", items=True)
QUERIES["mapped_sort"] = lambda spark, sf_dir: sinks.mapped_order(export.apply(A.valid(_checked(spark, sf_dir)), export.TEMPLATES["personal_expenses"], "file_id"), "Merchant").select("file_id", F.col("Merchant").alias("merchant"))
SQL["mapped_sort"] = sql(f"SELECT file_id, merchant_name AS merchant FROM r WHERE {_OKV} ORDER BY coalesce(merchant_name, ''), file_id")
QUERIES["mapped_group"] = lambda spark, sf_dir: (
    sinks.mapped_groups(export.apply(A.valid(_checked(spark, sf_dir)), export.TEMPLATES["personal_expenses"], "file_id"), "Merchant", "file_id").groupBy("group", "size").agg(F.count_distinct("place").alias("places"), F.max("place").alias("last"))
)
SQL["mapped_group"] = sql(f"SELECT coalesce(merchant_name, '') AS \"group\", count(*) AS size, count(*) AS places, count(*) AS last FROM r WHERE {_OKV} GROUP BY 1")
QUERIES["history"] = lambda spark, sf_dir: sinks.history(read(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id")
SQL["history"] = "WITH n AS (SELECT count(*) AS n FROM events), x AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS i FROM events) SELECT event_id FROM x, n WHERE i <= CASE WHEN n <= 100 THEN n ELSE 50 + (n - 101) % 51 END"
