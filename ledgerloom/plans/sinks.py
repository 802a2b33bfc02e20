"""Export files: rows of sheets, records as JSON, the text report, several templates, packages.

Executors write every file as a folder of parts; only sums and names reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.cluster import remove, stored, tidy_shuffles
from ledgerloom.operators import analytics as A
from ledgerloom.plans import export
from ledgerloom.sources import package

# Columns of the flat export, templates and charts of a package, bounds of the history.
RECORD = ("file_name", "merchant_name", "merchant_address", "merchant_phone", "date", "time", "subtotal", "tax_amount", "tip_amount", "total_amount", "payment_method", "card_last_four", "receipt_number", "ocr_method", "ocr_confidence")
ITEM = ("description", "quantity", "unit_price", "total_price", "confidence")
PACKAGE = ("personal_expenses", "business_expenses", "detailed_analysis")
CHARTS = ("spending_by_merchant", "spending_over_time")
#: Columns that a package's files are made of.
HELD = (*RECORD, "k", "file_id", "success", "processing_time", "confidence_score", "items", "is_valid", "validation_score", "issues", "warnings")
HISTORY, KEPT = 100, 50
VERSION = "1.0"
SECTIONS = ("statistics", "merchants", "methods", "receipts")


def _flat(scores: bool = True, texts: bool = False) -> list[Column]:
    extra = [F.col("is_valid").alias("validation_is_valid"), F.col("validation_score")] if scores else []
    return [F.coalesce("file_name", F.lit("Unknown")).alias("file_name"), *map(F.col, RECORD[1:]), F.col("confidence_score").alias("validation_confidence"), *extra, *([F.col("raw_text")] if texts else [])]


def csv_rows(df: DataFrame, scores: bool = True, texts: bool = False) -> DataFrame:
    """A row for each item of successful records, one without item columns for a record without items."""
    rows = A.successful(df).select(*_flat(scores, texts), F.posexplode_outer("items").alias("item_pos", "x"))
    return rows.select("*", *(F.col(f"x.{c}").alias(f"item_{c}") for c in ITEM)).drop("x")


def _json(scores: bool = True, texts: bool = False) -> Column:
    data = [c for c in (*RECORD[1:13], "confidence_score", "items")]
    parts = [
        F.struct("file_name", "file_id", F.coalesce("processing_time", F.lit(0.0)).alias("processing_time")).alias("file_info"),
        F.struct(F.col("ocr_method").alias("method"), F.coalesce("ocr_confidence", F.lit(0.0)).alias("confidence")).alias("ocr_info"),
        F.struct(*data).alias("receipt_data"),
    ]
    parts += [F.struct("is_valid", F.col("validation_score").alias("confidence_score")).alias("validation")] if scores else []
    parts += [F.col("raw_text")] if texts else []
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def json_rows(df: DataFrame, scores: bool = True, texts: bool = False) -> DataFrame:
    """(file_id, record) of successful records, the record as JSON."""
    return A.successful(df).select("file_id", _json(scores, texts).alias("record"))


def envelope(df: DataFrame, scores: bool = True, texts: bool = False) -> DataFrame:
    """What stands before the records of a JSON export."""
    n = F.count_if(F.col("success")).alias("total_receipts")
    return df.agg(n).select("total_receipts", F.lit(VERSION).alias("exporter_version"), F.lit(scores).alias("include_confidence_scores"), F.lit(texts).alias("include_raw_text"))


def _share(n: str, of: str):
    return F.when(F.col(of) > 0, F.format_string("%.1f%%", F.col(n) / F.col(of) * 100)).otherwise("0.0%")


def _usd(c: str):
    return F.concat(F.lit("$"), F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)").cast("string"))


def report(df: DataFrame, key: str = "k", block: int = 4096) -> DataFrame:
    """(section, place, line) of the text report: statistics, merchants by their sum, methods, and every successful record.

    Lines of a section are in the order of (place, line); the place of a merchant is its sum in cents, less than 0.
    Records are numbered by ``key``, in blocks of it whose sizes are added up, so that no task sees all.
    """
    ok = A.successful(df)
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("good"), F.sum(F.when(F.col("success"), F.col("total_amount"))).alias("total"))
    said = F.array(
        F.concat(F.lit("Total Receipts Processed: "), F.col("n").cast("string")), F.concat(F.lit("Successfully Parsed: "), F.col("good").cast("string")),
        F.concat(F.lit("Success Rate: "), _share("good", "n")), F.concat(F.lit("Total Amount: "), _usd("total")),
    )
    first = sums.select(F.lit("statistics").alias("section"), F.posexplode(said).alias("place", "line")).withColumn("place", F.col("place").cast("long") + 1)

    def counted(section: str, name, line, place):
        groups = ok.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("total"))
        return groups.select(F.lit(section).alias("section"), place.cast("long").alias("place"), line.alias("line"))

    n = F.col("n").cast("string")
    merchants = counted("merchants", A.named(), F.concat("name", F.lit(": "), n, F.lit(" receipts, "), _usd("total")), -F.coalesce(F.col("total"), F.lit(0)) * 100)
    methods = counted("methods", F.coalesce("ocr_method", F.lit("unknown")), F.concat("name", F.lit(": "), n, F.lit(" receipts")), F.lit(0))
    rows = ok.withColumns({"block": F.floor(F.col(key) / block), "n_items": F.size("items")})  # counted here, so that no shuffle takes the items along
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("block", (F.sum("size").over(Window.orderBy("block")) - F.col("size")).alias("before"))
    placed = rows.join(before, "block").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy(key)))
    shown = F.concat_ws(
        "\n", F.concat(F.col("place").cast("string"), F.lit(". "), F.coalesce("file_name", F.lit("Unknown"))), F.concat(F.lit("   Merchant: "), A.named()),
        F.concat(F.lit("   Date: "), F.coalesce(F.col("date").cast("string"), F.lit("Unknown"))), F.concat(F.lit("   Total: "), _usd("total_amount")),
        F.concat(F.lit("   Confidence: "), F.format_string("%.1f%%", F.coalesce("confidence_score", F.lit(0.0)) * 100)), F.concat(F.lit("   Items: "), F.col("n_items").cast("string")),
    )
    return first.unionByName(merchants).unionByName(methods).unionByName(placed.select(F.lit("receipts").alias("section"), "place", shown.alias("line")))


def many(df: DataFrame, names: tuple[str, ...] = tuple(export.TEMPLATES), key: str = "file_id") -> DataFrame:
    """(template, key, fields) of several templates; names without a template are left out, as are all if none has one."""
    made = []
    for name in (n for n in names if n in export.TEMPLATES):
        x = export.apply(df, export.TEMPLATES[name], key)
        cells = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in x.columns if c != key]
        made.append(x.select(F.lit(name).alias("template"), key, F.map_from_entries(F.array(*cells)).alias("fields")))
    out = made[0] if made else df.limit(0).select(F.lit("").alias("template"), key, F.create_map().cast("map<string,string>").alias("fields"))
    for x in made[1:]:
        out = out.unionByName(x)
    return out


def mapped_order(df: DataFrame, name: str) -> DataFrame:
    """Exported rows by one exported field, missing values as empty ones."""
    return df.orderBy(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))


def mapped_groups(df: DataFrame, name: str, key: str, per: int = 4096) -> DataFrame:
    """Exported rows numbered within the group of one exported field, missing values as empty ones: (group, size, place, ...).

    A group is dealt by ranges of ``key`` of about ``per`` rows, whose sizes are added up, so a value that most rows share isn't one task's.
    """
    group = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = df.withColumn("group", group)
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    salted = rows.join(sizes, "group").withColumn("salt", F.pmod(F.xxhash64(key), F.ceil(F.col("size") / per)).cast("int"))
    blocks = salted.groupBy("group", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = blocks.select("group", "salt", (F.sum("n").over(Window.partitionBy("group").orderBy("salt")) - F.col("n")).alias("before"))
    placed = salted.join(before, ["group", "salt"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("group", "salt").orderBy(key))
    return placed.withColumn("place", place).drop("salt", "before")


def kinds(wanted: str) -> tuple[str, ...]:
    """The formats to write: the one wanted, or all if it isn't known."""
    return (wanted.lower(),) if wanted.lower() in export.FORMATS else export.FORMATS


def _texts(df: DataFrame, file: str, *order, header: tuple[str, ...] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """Rows of one file of a package, as texts: (file, section, place, key, cells); and its columns."""
    names = list(header if header is not None else df.columns)
    at = [*order, F.lit(0), F.lit(0), F.lit("")][: 3 if not order else len(order)]
    cells = F.array(*(F.col(f"`{c}`").cast("string") for c in df.columns if header is None or c in header)) if names else F.array(F.col(df.columns[0]).cast("string"))
    made = df.select(F.lit(file).alias("file"), at[0].cast("int").alias("section"), at[1].cast("long").alias("place"), at[2].cast("string").alias("key"), cells.alias("cells"))
    return made, {file: names}


#: Of formats of sheets: a row's cells as text, what stands between texts of cells, a row of such a text.
_ROWS = {"csv": (package.csv_cells, ",", package.csv_row), "xlsx": (package.xml_cells, "", package.xml_row)}


def _sheet(kind: str) -> Column:
    """The text of a record's rows of a sheet: a row for each item, one without item columns for a record without items."""
    cells, between, row = _ROWS[kind]
    line = lambda own: row(F.concat(F.col(f"base_{kind}"), F.lit(between), cells(own)))
    of_item = lambda x, i: line(F.array(i.cast("string"), *(x[c].cast("string") for c in ITEM)))
    none = F.array(*[F.lit(None).cast("string")] * (len(ITEM) + 1))
    return F.when(F.size("items") > 0, F.array_join(F.transform("items", of_item), "")).otherwise(line(none))


def _of_records(df: DataFrame, wanted: str, used: list[export.Template]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Texts (file, place, n, text) that one record gives, for all files, and the columns of each file: sheets and JSON of successful records, templates of valid ones.

    A record's rows follow each other: files are written from the records as they are ordered, without a shuffle of what they turn into. What a record's
    rows have in common is turned into text once.
    """
    sheets, shown = [k for k in kinds(wanted) if k != "json"], "json" in kinds(wanted)
    held, made = export.held(A.successful(df), used)
    rows, headers = [], {}
    add = lambda file, n, text: rows.append(F.struct(F.lit(file).alias("file"), n.cast("int").alias("n"), text.alias("text")))
    cells = held.select("place", "items", F.array(*(c.cast("string") for c in _flat())).alias("base"), _json().alias("json"), *(F.when(A.is_valid(), c).alias(f"c{i}") for i, c in enumerate(made)))
    cells = cells.select("*", *(_ROWS[k][0](F.col("base")).alias(f"base_{k}") for k in sheets))
    for k in sheets:
        add(f"spreadsheets/receipts.{k}", F.greatest(F.size("items"), F.lit(1)), _sheet(k))
        headers[f"spreadsheets/receipts.{k}"] = csv_rows(df).columns
    if shown:
        add("spreadsheets/receipts.json", F.lit(1), F.concat("json", F.lit("\n")))
        headers["spreadsheets/receipts.json"] = []
    for i, t in enumerate(used):
        for k in t.formats:
            headers[f"templates/{t.name}.{k}"] = export.header(t)
            add(f"templates/{t.name}.{k}", F.lit(1), F.when(F.col(f"c{i}").isNotNull(), package.row(F.col(f"c{i}"), k, export.header(t))))
    return cells.select("place", F.inline(F.array(*rows))).where("text IS NOT NULL"), headers


def _of_reports(df: DataFrame, reports: bool) -> tuple[DataFrame, dict[str, list[str]]]:
    """Rows (file, section, place, key, cells) of the text report, and of a line of statistics and the data of the charts."""
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    parts = [_texts(report(df).select("line", "section", "place"), "reports/summary.txt", order, F.col("place"), F.col("line"), header=())]
    if reports:
        ok = A.successful(df)
        total = F.sum("total_amount").alias("total")
        sums = df.agg(F.count(F.lit(1)).alias("receipts"), F.count_if("success").alias("successful"), F.sum(F.when(F.col("success"), F.col("total_amount"))).alias("total"), F.round(F.avg("ocr_confidence"), 6).alias("ocr_confidence"))
        parts.append(_texts(sums, "reports/statistics.json"))
        by_name, by_day = ok.groupBy(A.named().alias("merchant")).agg(total), ok.where("date IS NOT NULL").groupBy("date").agg(total)
        parts.append(_texts(by_name, f"reports/{CHARTS[0]}.csv", F.lit(0), -F.coalesce(F.col("total"), F.lit(0)) * 100, F.col("merchant")))
        parts.append(_texts(by_day, f"reports/{CHARTS[1]}.csv", F.lit(0), F.lit(0), F.col("date")))
    rows, headers = parts[0]
    for more, own in parts[1:]:
        rows, headers = rows.unionByName(more), headers | own
    return rows, headers


def write_package(df: DataFrame, folder: str, wanted: str = "csv", names: tuple[str, ...] = PACKAGE, reports: bool = True, key: str = "file_id", codec: str = "none") -> DataFrame:
    """Writes a package in one job and returns its manifest (file, rows, bytes, parts): what was committed, counted by the tasks that wrote it.

    Records are written to the shared folder first, of the columns that files are made of, then once more in ranges of ``key`` with their places, and the first copy goes.
    Shuffle files go with the job that made them. A task then writes a part of each file that is made of records, so only records are shuffled, before the package is there,
    and not their rows of all files. Rows of reports are dealt in ranges of their own; parts follow the order of rows. ``codec`` compresses texts.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ("file", "section", "place", "key")
    used = [export.TEMPLATES[n] for n in names if n in export.TEMPLATES]
    with tidy_shuffles(spark):
        first = stored(df.select(*(c for c in df.columns if c in HELD or c == key)), "package-records", "zstd")
        held = stored(first.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("place", F.monotonically_increasing_id()), "package-ordered", "zstd")
        remove(first)
        rows, headers = _of_records(held, wanted, used)
        more, own = _of_reports(held.drop("place"), reports)
        more = more.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        return package.write(rows.unionByName(package.texts(more, own)), folder, headers | own, codec)


def missing_templates(names: tuple[str, ...]) -> list[dict]:
    """Entries of a package for templates that there aren't: they fail alone."""
    return [{"template_name": n, "success": False, "error": "Template not found"} for n in names if n not in export.TEMPLATES]


def package_counts(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sums of a written package: files with rows by kind, templates, and the successful records it was made of."""
    there = manifest.where(F.size("parts") > 0).select(F.split("file", "/").alias("p"))
    kind = lambda k: F.count_if(F.col("p")[0] == k)
    name = F.when(F.col("p")[0] == "templates", F.substring_index(F.col("p")[1], ".", 1))
    sums = there.agg(
        kind("spreadsheets").alias("spreadsheet_files"), kind("reports").alias("report_files"), kind("templates").alias("template_files"), F.count_distinct(name).alias("templates_used"), F.count(F.lit(1)).alias("total_files_created")
    )
    return df.agg(F.count_if("success").alias("receipts_processed")).crossJoin(sums)  # two rows of sums


def ring(n: int) -> int:
    """How many of n operations the history still holds: beyond 100 it is cut to the last 50 and grows again."""
    return n if n <= HISTORY else KEPT + (n - HISTORY - 1) % (HISTORY - KEPT + 1)


def history(df: DataFrame, *order: str, last: int | None = None) -> DataFrame:
    """The operations that the history holds, or the last few of them."""
    kept = ring(df.count())
    return df.orderBy(*(F.desc(c) for c in order)).limit(kept if last is None else min(last, kept))
