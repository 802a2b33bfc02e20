"""Incremental ingest of records as a stream: an extension.

Files that arrive are extracted once; repeats of an id within the watermark are dropped by Spark's own state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import text


def source(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once(df: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def extracted(df: DataFrame) -> DataFrame:
    """The extraction of a batch, unchanged, on a stream: it is a projection."""
    return text.extract(df)


def spend_by_day(df: DataFrame, time: str, amount: str, late: str = "1 day") -> DataFrame:
    """Sums by day windows, final once the watermark has passed."""
    return df.withWatermark(time, late).groupBy(F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
