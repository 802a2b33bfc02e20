"""Queries of filters, aggregations, windows, orderings: (Spark plan, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import analytics as A
from ledgerloom.sources.records import records, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

_VALID, _OK = "success AND confidence_score > 0", "success"
_NAME = "CASE WHEN coalesce(merchant_name, '') <> '' THEN merchant_name ELSE 'Unknown' END"
_SUM = "coalesce(sum(total_c), 0) / 100.0::DOUBLE"


def add(name: str, plan, text: str, items: bool = False, **needs) -> None:
    """``plan`` takes the records."""
    QUERIES[name] = lambda spark, sf_dir: plan(records(spark, sf_dir, items=items, **needs))
    SQL[name] = sql(text, items=items)


def _n() -> object:
    return F.count(F.lit(1)).alias("n_records")


add("filter_success", lambda r: A.successful(r).select("file_id", "total_c"), f"SELECT file_id, total_c FROM r WHERE {_OK}")
add("filter_valid", lambda r: A.valid(r).select("file_id", "total_c", "confidence_score"), f"SELECT file_id, total_c, confidence_score FROM r WHERE {_VALID}")
add("filter_threshold", lambda r: r.where("confidence_score >= 0.8").select("file_id", "confidence_score"), "SELECT file_id, confidence_score FROM r WHERE confidence_score >= 0.8")
add(
    "status_counts",
    lambda r: r.select(F.when(~F.col("success"), "error").when(F.col("k") % 10 == 0, "skipped").otherwise("processed").alias("status")).groupBy("status").agg(_n()),
    "SELECT CASE WHEN NOT success THEN 'error' WHEN k % 10 = 0 THEN 'skipped' ELSE 'processed' END AS status, count(*) AS n_records FROM r GROUP BY 1",
)
add(
    "tax_rates",
    lambda r: A.valid(r).where("total_c > 0").select("file_id", (F.col("tax_c") / F.col("total_c") * 100).alias("tax_rate")).where("tax_rate BETWEEN 0 AND 20"),
    f"WITH x AS (SELECT file_id, tax_c::DOUBLE / total_c::DOUBLE * 100 AS tax_rate FROM r WHERE {_VALID} AND total_c > 0) SELECT * FROM x WHERE tax_rate BETWEEN 0 AND 20",
)
add(
    "agg_summary",
    lambda r: A.valid(r).agg(
        A.total().alias("amount"), A.total("tax_amount").alias("tax"), A.total("tip_amount").alias("tip"), _n(), F.count_distinct("merchant_name").alias("unique_merchants"),
        F.sum(F.size("items")).alias("total_items"), F.min("date").cast("string").alias("earliest"), F.max("date").cast("string").alias("latest"),
        F.array_join(F.array_sort(F.collect_set("merchant_name")), ",").alias("merchants"),
        (F.sum(F.round(F.col("confidence_score") * 1000).cast("bigint")) / F.count(F.lit(1))).alias("avg_confidence_permille"),
    ),
    f"""WITH n AS (SELECT k, count(*) AS n FROM i1 GROUP BY k), v AS (SELECT r.*, coalesce(n.n, 0) AS n FROM r LEFT JOIN n ON r.k = n.k WHERE {_VALID})
    SELECT {_SUM} AS amount, coalesce(sum(tax_c), 0) / 100.0::DOUBLE AS tax, coalesce(sum(tip_c), 0) / 100.0::DOUBLE AS tip, count(*) AS n_records,
      count(DISTINCT merchant_name) AS unique_merchants, sum(n)::BIGINT AS total_items, min(dt)::VARCHAR AS earliest, max(dt)::VARCHAR AS latest,
      array_to_string(list_sort(list_distinct(list(merchant_name))), ',') AS merchants,
      sum(round(confidence_score * 1000)::BIGINT)::DOUBLE / count(*)::DOUBLE AS avg_confidence_permille FROM v""",
    items=True,
)
add(
    "agg_cli",
    lambda r: A.successful(r).agg(_n(), A.total().alias("total_spent"), F.count_distinct("merchant_name").alias("n_merchants"), (F.sum(F.col("k") % 101) / F.count(F.lit(1)) / 100).alias("avg_ocr_confidence")),
    f"SELECT count(*) AS n_records, {_SUM} AS total_spent, count(DISTINCT merchant_name) AS n_merchants, sum(k % 101)::DOUBLE / count(*)::DOUBLE / 100 AS avg_ocr_confidence FROM r WHERE {_OK}",
)
add("agg_methods", lambda r: A.successful(r).groupBy("ocr_method").agg(_n()), f"SELECT ocr_method, count(*) AS n_records FROM r WHERE {_OK} GROUP BY 1")
add(
    "agg_sheet",
    lambda r: A.successful(r).agg(_n(), A.total().alias("total_spent"), F.count_distinct("merchant_name").alias("n_merchants"), (F.sum(F.col("k") * 7 % 101) / F.count(F.lit(1)) / 100).alias("avg_confidence")),
    f"SELECT count(*) AS n_records, {_SUM} AS total_spent, count(DISTINCT merchant_name) AS n_merchants, sum(k * 7 % 101)::DOUBLE / count(*)::DOUBLE / 100 AS avg_confidence FROM r WHERE {_OK}",
)
_SPEND = f"count(*) AS n_records, {_SUM} AS total_spent, ({_SUM}) / count(*)::DOUBLE AS average"
add(
    "merchant_breakdown",
    lambda r: A.top(A.spend(A.successful(r), F.col("merchant_name"), "merchant"), 10, "total_spent", "merchant"),
    f"SELECT merchant_name AS merchant, {_SPEND} FROM r WHERE {_OK} GROUP BY 1 ORDER BY total_spent DESC, merchant NULLS FIRST LIMIT 10",
)
add("report_breakdown", lambda r: A.spend(A.successful(r), F.col("merchant_name"), "merchant"), f"SELECT merchant_name AS merchant, {_SPEND} FROM r WHERE {_OK} GROUP BY 1")


#: Ids that share so many first characters make one range of a group.
HEAD = 3


def _listed(r: DataFrame, key: object, name: str) -> DataFrame:
    """A row for each group with all its ids in their order: ranges of ids are sorted side by side, a group's row only puts its ranges one after another."""
    ranges = A.valid(r).groupBy(key.alias(name), F.substring("file_id", 1, HEAD).alias("head")).agg(_n(), F.array_join(F.array_sort(F.collect_list("file_id")), ",").alias("ids"))
    groups = ranges.groupBy(name).agg(F.sum("n_records").alias("n_records"), F.array_sort(F.collect_list(F.struct("head", "ids"))).alias("ranges"))
    return groups.select(name, "n_records", F.array_join("ranges.ids", ",").alias("file_ids"))


_ids = f"count(*) AS n_records, string_agg(file_id, ',' ORDER BY file_id) AS file_ids FROM r WHERE {_VALID} GROUP BY 1"
add("group_merchant", lambda r: _listed(r, A.named(), "merchant"), f"SELECT {_NAME} AS merchant, {_ids}")
add("group_date", lambda r: _listed(r, F.coalesce(F.col("date").cast("string"), F.lit(A.UNKNOWN)), "day"), f"SELECT coalesce(dt::VARCHAR, 'Unknown') AS day, {_ids}")
_DATED = f"{_VALID} AND dt IS NOT NULL"
_dated = lambda r: A.valid(r).where("date IS NOT NULL")
_spent = lambda: A.total().alias("total_spent")
add("monthly", lambda r: A.by(_dated(r), F.date_format("date", "yyyy-MM"), "month", _spent()), f"SELECT strftime(dt, '%Y-%m') AS month, {_SUM} AS total_spent FROM r WHERE {_DATED} GROUP BY 1")
_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _weekdays(r: DataFrame) -> DataFrame:
    days = r.sparkSession.createDataFrame([(i, d) for i, d in enumerate(_DAYS)], "i int, weekday string")
    sums = A.by(_dated(r), F.weekday("date"), "i", (A.total() / F.count(F.lit(1))).alias("average"))
    return A.dense(sums, days.select("i"), "i", "average").join(days, "i").select("weekday", "average")


add(
    "weekday_avg", _weekdays,
    f"""WITH d AS (SELECT unnest(range(7)) AS i, unnest({list(_DAYS)}) AS weekday), s AS (SELECT isodow(dt) - 1 AS i, ({_SUM}) / count(*)::DOUBLE AS average FROM r WHERE {_DATED} GROUP BY 1)
    SELECT weekday, coalesce(average, 0) AS average FROM d LEFT JOIN s USING (i)""",
)
_method = lambda: F.when(F.coalesce(F.col("payment_method"), F.lit("")) != "", F.col("payment_method")).otherwise(A.UNKNOWN)
add(
    "payment_dist",
    lambda r: A.by(A.valid(r), _method(), "payment_method", _n()).withColumn("share", F.col("n_records") / F.sum("n_records").over(Window.partitionBy(F.lit(0)))),
    f"SELECT coalesce(payment_method, 'Unknown') AS payment_method, count(*) AS n_records, count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS share FROM r WHERE {_VALID} GROUP BY 1",
)
add("merchant_freq", lambda r: A.top(A.by(A.valid(r), A.named(), "merchant", _n()), 10, "n_records", "merchant"), f"SELECT {_NAME} AS merchant, count(*) AS n_records FROM r WHERE {_VALID} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("merchant_spend", lambda r: A.top(A.by(A.valid(r), A.named(), "merchant", _spent()), 10, "total_spent", "merchant"), f"SELECT {_NAME} AS merchant, {_SUM} AS total_spent FROM r WHERE {_VALID} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add(
    "merchant_avg", lambda r: A.top(A.spend(A.valid(r), A.named(), "merchant").select("merchant", "average"), 10, "average", "merchant"),
    f"SELECT {_NAME} AS merchant, ({_SUM}) / count(*)::DOUBLE AS average FROM r WHERE {_VALID} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
add(
    "merchant_others", lambda r: A.with_others(A.valid(r)),
    f"""WITH s AS (SELECT {_NAME} AS merchant, sum(total_c) AS c FROM r WHERE {_VALID} GROUP BY 1), q AS (SELECT *, row_number() OVER (ORDER BY c DESC, merchant) AS i FROM s)
    SELECT CASE WHEN i <= 8 THEN merchant ELSE 'Others' END AS merchant, sum(c) / 100.0::DOUBLE AS total_spent FROM q GROUP BY 1 HAVING sum(c) > 0""",
)
add(
    "hourly_avg", lambda r: A.by(A.valid(r).where("time IS NOT NULL"), A.hour(F.col("time")), "hour", (A.total() / F.count(F.lit(1))).alias("average")),
    f"SELECT split_part(tm, ':', 1)::INT AS hour, ({_SUM}) / count(*)::DOUBLE AS average FROM r WHERE {_VALID} AND tm IS NOT NULL GROUP BY 1",
)
add(
    "weekly", lambda r: A.by(_dated(r), A.week_key(F.col("date")), "week", _spent()).orderBy(F.col("week").desc()).limit(12),
    f"SELECT year(dt) || '-W' || lpad(weekofyear(dt)::VARCHAR, 2, '0') AS week, {_SUM} AS total_spent FROM r WHERE {_DATED} GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
)


def _seasons(r: DataFrame) -> DataFrame:
    names = r.sparkSession.createDataFrame([(s,) for s in ("Spring", "Summer", "Fall", "Winter")], "season string")
    return A.dense(A.by(_dated(r), A.season(F.col("date")), "season", _spent()), names, "season", "total_spent")


add(
    "seasonal", _seasons,
    f"""WITH d AS (SELECT unnest(['Spring', 'Summer', 'Fall', 'Winter']) AS season),
    s AS (SELECT CASE WHEN month(dt) IN (12, 1, 2) THEN 'Winter' WHEN month(dt) < 6 THEN 'Spring' WHEN month(dt) < 9 THEN 'Summer' ELSE 'Fall' END AS season, {_SUM} AS total_spent FROM r WHERE {_DATED} GROUP BY 1)
    SELECT season, coalesce(total_spent, 0) AS total_spent FROM d LEFT JOIN s USING (season)""",
)
add("daily_counts", lambda r: A.by(_dated(r), F.col("date").cast("string"), "day", _n()), f"SELECT dt::VARCHAR AS day, count(*) AS n_records FROM r WHERE {_DATED} GROUP BY 1")
add("daily_totals", lambda r: A.by(A.successful(r).where("date IS NOT NULL"), F.col("date").cast("string"), "day", _spent()), f"SELECT dt::VARCHAR AS day, {_SUM} AS total_spent FROM r WHERE {_OK} AND dt IS NOT NULL GROUP BY 1")


def _hist_sql(value: str, bins: int, where: str) -> str:
    return f"""WITH v AS (SELECT {value} AS v FROM r WHERE {where}), e AS (SELECT min(v) AS low, (max(v) - min(v)) / {bins} AS w FROM v)
    SELECT least({bins - 1}, floor((v - low) / w))::INT AS bin, count(*) AS n_records FROM v, e GROUP BY 1"""


add("hist_spend", lambda r: A.histogram(A.valid(r), F.col("total_c") / 100, 20), _hist_sql("total_c / 100.0::DOUBLE", 20, _VALID))
add("hist_tax", lambda r: A.histogram(A.valid(r), F.col("tax_c") / F.col("total_c") * 100, 15), _hist_sql("tax_c::DOUBLE / total_c::DOUBLE * 100", 15, _VALID))
add("hist_conf", lambda r: A.histogram(A.valid(r), F.col("confidence_score"), 20), _hist_sql("confidence_score", 20, _VALID))
add("hist_time", lambda r: A.histogram(A.valid(r).where("processing_time > 0"), F.col("processing_time"), 20), _hist_sql("processing_time", 20, f"{_VALID} AND processing_time > 0"))
add(
    "cumulative", lambda r: A.cumulative(A.valid(r)).withColumn("date", F.col("date").cast("string")),
    f"SELECT file_id, dt::VARCHAR AS date, sum(total_c) OVER (ORDER BY dt, total_c, file_id ROWS UNBOUNDED PRECEDING)::BIGINT / 100.0::DOUBLE AS running_total FROM r WHERE {_DATED}",
)
for _key, _order in (("date", "coalesce(dt, DATE '0001-01-01')"), ("merchant", "lower(coalesce(merchant_name, ''))"), ("amount", "total_c DESC"), ("confidence", "confidence_score DESC")):
    add(
        f"sort_{_key}",
        lambda r, key=_key, down=_key in ("amount", "confidence"): A.ordered(A.valid(r), key, down).select("file_id", "merchant_name", "total_c"),
        f"SELECT file_id, merchant_name, total_c FROM r WHERE {_VALID} ORDER BY {_order}, file_id",
    )
add("topk", lambda r: A.top(A.valid(r).select("file_id", "total_c"), 25, "total_c", "file_id"), f"SELECT file_id, total_c FROM r WHERE {_VALID} ORDER BY total_c DESC, file_id LIMIT 25")
add(
    "detail_list", lambda r: A.ordered(A.valid(r), "date").limit(25).select("file_id", F.substring(A.named(), 1, 20).alias("merchant"), F.lit("N/A").alias("confidence"), "total_c"),
    f"SELECT file_id, substr({_NAME}, 1, 20) AS merchant, 'N/A' AS confidence, total_c FROM r WHERE {_VALID} ORDER BY coalesce(dt, DATE '0001-01-01'), file_id LIMIT 25",
)
# Extensions: calculations that templates declare.
add(
    "quarterly_total", lambda r: A.by(_dated(r), F.concat(F.year("date").cast("string"), F.lit("-Q"), F.quarter("date").cast("string")), "quarter", _spent()),
    f"SELECT year(dt) || '-Q' || quarter(dt) AS quarter, {_SUM} AS total_spent FROM r WHERE {_DATED} GROUP BY 1",
)
