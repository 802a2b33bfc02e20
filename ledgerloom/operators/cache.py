"""State of a file cache as relations: listing, latest state, evictions, statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MB = 1048576


def listing(df: DataFrame) -> DataFrame:
    """Defaults for what is missing."""
    return df.select("file_id", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("last_accessed", "cached_at").alias("last_accessed"))


def statistics(df: DataFrame, cap_mb: int = 1000) -> DataFrame:
    """Files, duplicates, size and use; ``unique_files_reported`` takes duplicates off a count without them."""
    once = F.count(F.when(~F.col("is_duplicate"), 1))
    size = F.sum(F.when(~F.col("is_duplicate"), F.col("size")).otherwise(0))
    twice = F.count(F.when(F.col("is_duplicate"), 1))
    return df.agg(
        once.alias("unique_files"), twice.alias("duplicates"), (once - twice).alias("unique_files_reported"),
        F.round(size / MB, 2).alias("size_mb"), F.round(size / MB / cap_mb * 100, 1).alias("usage_percent"),
    )


def aged(df: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    return df.where(F.col("cached_at") < F.lit(as_of) - F.expr(f"INTERVAL {days} DAY"))


def lru_evicted(df: DataFrame, cap: int) -> DataFrame:
    """Files to remove, longest unused first, until the rest fits ``cap`` bytes.

    Sizes are added up by day of last use, then within each day, so that no task orders all files.
    """
    kept = df.where("NOT is_duplicate").select("file_id", "size", "last_accessed", F.to_date("last_accessed").alias("day"))
    days = kept.groupBy("day").agg(F.sum("size").alias("day_size"))
    earlier, every = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    days = days.select("day", F.coalesce(F.sum("day_size").over(earlier), F.lit(0)).alias("before"), F.sum("day_size").over(every).alias("all"))
    within = Window.partitionBy("day").orderBy("last_accessed", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    removed = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return kept.join(days, "day").withColumn("removed_before", removed).where(F.col("all") - F.col("removed_before") > cap).select("file_id", "size", "removed_before")


def latest(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The latest row of each key of an append-only log: a grouped maximum, not a window."""
    others = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("x")).select(key, "x.*")


def ingest(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Status and reason of each file: cached ones are skipped, empty ones fail, copies of a content are duplicates."""
    known = files.join(cached.select("file_id").distinct(), "file_id", "left_semi").select("file_id", F.lit("skipped").alias("status"), F.lit("already cached").alias("reason"))
    new = files.join(cached.select("file_id"), "file_id", "left_anti")
    firsts = new.groupBy("digest").agg(F.min("file_id").alias("first"))
    reason = F.when(F.col("size") == 0, "empty").when(F.col("first") != F.col("file_id"), "duplicate content")
    done = new.join(firsts, "digest").select("file_id", F.when(F.col("size") == 0, "error").otherwise("processed").alias("status"), reason.alias("reason"))
    return known.unionByName(done)
