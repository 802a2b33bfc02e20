"""File sources: images of folders, templates of files, and file tables derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.records import read

#: Image types.
IMAGES = ("image/jpeg", "image/png", "image/gif", "image/bmp", "image/tiff", "image/webp")


def images(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png,gif,bmp,tif,tiff,webp}") -> DataFrame:
    """(path, modificationTime, length, content) of the image files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of files, one for each document: name, type, size, times, content digest."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    kinds = F.get(F.array(*map(F.lit, (*IMAGES, "application/folder"))), (i % 7).cast("int"))
    digest = F.md5("text")
    return d.select(
        i.alias("file_id"), F.when(i % 17 != 0, F.concat(F.lit("IMG_"), i.cast("string"), F.lit(".jpg"))).alias("name"), kinds.alias("mime"),
        F.when(i % 19 != 0, F.octet_length("text").cast("long")).alias("size"), (start + hours(i % 2000)).alias("cached_at"),
        F.when(i % 3 != 0, start + hours(i * 7 % 2500)).alias("last_accessed"), digest.alias("digest"), (i % 10 == 0).alias("is_duplicate"),
    )


FILES_SQL = f"""
c AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 17 <> 0 THEN 'IMG_' || doc_id || '.jpg' END AS name, {[*IMAGES, 'application/folder']}[doc_id % 7 + 1] AS mime,
  CASE WHEN doc_id % 19 <> 0 THEN strlen(text) END AS size, TIMESTAMP '2024-01-01' + to_hours((doc_id % 2000)::INT) AS cached_at,
  CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours((doc_id * 7 % 2500)::INT) END AS last_accessed, md5(text) AS digest, doc_id % 10 = 0 AS is_duplicate FROM documents)"""
