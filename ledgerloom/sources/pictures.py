"""Pictures of vectors: 64 vectors of 64 numbers in the order of their ids are the rows of a grey picture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.records import read

SIDE = 64


def grey_bytes(v):
    """Numbers as bytes: 128 + 256 x, rounded down, within 0 and 255."""
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 256) + 128)).cast("int")
    return F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(byte(x)), 2, "0")), ""))


def from_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(picture_id, data, width, height); vectors that are null or not of ``SIDE`` numbers are no rows. At most ``SIDE`` rows meet in a picture.

    Pictures are spread by their ids over all partitions, as kernels cost far more than their bytes suggest.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = read(spark, sf_dir, "embeddings").where(F.size("embedding") == SIDE)
    rows = v.select(F.floor(F.col("vec_id") / SIDE).alias("picture_id"), F.struct("vec_id", grey_bytes(F.col("embedding")).alias("line")).alias("r"))
    lines = F.transform(F.sort_array(F.collect_list("r")), lambda r: F.hex(r["line"]))
    made = rows.repartition(parts, "picture_id").groupBy("picture_id").agg(F.unhex(F.array_join(lines, "")).alias("data"), F.count(F.lit(1)).cast("int").alias("height"))
    return made.select("picture_id", "data", F.lit(SIDE).alias("width"), "height")
