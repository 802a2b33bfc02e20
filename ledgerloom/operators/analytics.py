"""Aggregations, windows and orderings over typed records.

Every operator takes and returns a DataFrame; money stays DECIMAL until the last projection. Ties in
rankings are broken by name or id, so results have one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def successful(df: DataFrame) -> DataFrame:
    return df.where("success")


def is_valid() -> Column:
    return F.expr("success AND confidence_score > 0")


def valid(df: DataFrame) -> DataFrame:
    return df.where(is_valid())


def named(c: str = "merchant_name") -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(UNKNOWN)


def total(c: str = "total_amount") -> Column:
    """A sum of money as a double; 0 without rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def by(df: DataFrame, key: Column, name: str, *measures: Column) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(*measures)


def top(df: DataFrame, n: int, by_desc: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(by_desc).desc(), *(F.col(t).asc_nulls_first() for t in ties)).limit(n)


def spend(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Count, sum and average per record by key; the average counts records without a total too."""
    sums = by(df, key, name, F.count(F.lit(1)).alias("n_records"), total().alias("total_spent"))
    return sums.withColumn("average", F.col("total_spent") / F.col("n_records"))


def with_others(df: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` merchants of highest spend, and one row for the rest if that is above 0."""
    sums = by(df, named(), "merchant", F.sum("total_amount").alias("m"))
    first = F.row_number().over(Window.orderBy(F.col("m").desc_nulls_last(), "merchant")) <= n  # a row for each merchant
    out = sums.select(F.when(first, F.col("merchant")).otherwise("Others").alias("merchant"), "m")
    return out.groupBy("merchant").agg(total("m").alias("total_spent")).where("merchant <> 'Others' OR total_spent > 0")


def dense(sums: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """A row for every key of ``keys``, 0 where there is nothing."""
    return keys.join(sums, key, "left").select(key, F.coalesce(F.col(value), F.lit(0.0)).alias(value))


def week_key(d: Column) -> Column:
    """Calendar year and ISO week, which differ around the new year."""
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def season(d: Column) -> Column:
    m = F.month(d)
    return F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").otherwise("Fall")


def hour(time: Column) -> Column:
    """The number before the first colon; am and pm don't count."""
    return F.regexp_extract(time, r"^(\d+):", 1).try_cast("int")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, n_records) of equal-width bins between the least and the greatest value, the last one closed."""
    v = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width == 0, F.lit(bins // 2)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / width)))
    return v.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_records"))  # ends: one row


def cumulative(df: DataFrame) -> DataFrame:
    """Running spend by (date, amount, id).

    Days are summed first and added up over days; within a day the sum runs in its own window, so no
    task holds more than the days or the records of one day.
    """
    dated = df.where("date IS NOT NULL AND total_amount IS NOT NULL").select("file_id", "date", "total_amount")
    days = dated.groupBy("date").agg(F.sum("total_amount").alias("day"))
    before = days.select("date", F.coalesce(F.sum("day").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("date").orderBy("total_amount", "file_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = dated.join(before, "date")
    return rows.select("file_id", "date", (F.col("before") + F.sum("total_amount").over(within)).cast("double").alias("running_total"))


def ordered(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Stable order by date, merchant, amount or confidence; missing dates and names come first."""
    keys = {
        "date": F.coalesce(F.col("date"), F.lit("0001-01-01").cast("date")),
        "merchant": F.lower(F.coalesce("merchant_name", F.lit(""))),
        "amount": F.coalesce("total_amount", F.lit(0)),
        "confidence": F.coalesce("confidence_score", F.lit(0.0)),
    }
    own = keys[key].desc() if descending else keys[key].asc()
    return df.orderBy(own, "file_id")
