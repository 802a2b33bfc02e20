"""Choice and confidence of recognised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choose(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The first engine that is good enough: vision, then document detection, then tesseract at any confidence, else none."""
    good = lambda ok, c: F.coalesce(F.col(ok) & (F.col(c) >= threshold), F.lit(False))
    pick = lambda a, b, c, d: F.when(good("vision_ok", "vision_conf"), a).when(good("doc_ok", "doc_conf"), b).when(F.coalesce("tess_ok", F.lit(False)), c).otherwise(d)
    return df.withColumn("method", pick(F.lit("google_vision"), F.lit("document_detection"), F.lit("tesseract"), F.lit("none"))).withColumn(
        "confidence", pick(F.col("vision_conf"), F.col("doc_conf"), F.col("tess_conf"), F.lit(0.0))
    )


def word_confidence(words: DataFrame, key: str, percent: str = "percent") -> DataFrame:
    """Mean over words; ``percent`` is an integer."""
    return words.groupBy(key).agg((F.sum(percent) / F.count(F.lit(1)) / 100).alias("confidence"))


def document_confidence(words: DataFrame, key: str, paragraph: str, percent: str = "percent") -> DataFrame:
    """Mean over paragraphs of the mean over their words."""
    inner = words.groupBy(key, paragraph).agg((F.sum(percent) / F.count(F.lit(1))).alias("p"))
    return inner.groupBy(key).agg(F.round(F.avg("p") / 100, 6).alias("confidence"))


def engine_confidence(values: Column) -> Column:
    """Mean of an array's positive values as a share; 0 without any."""
    kept = F.filter(values, lambda v: v > 0)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept) / 100).otherwise(0.0)
