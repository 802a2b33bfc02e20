"""Scans of a file library: folders, albums and their items, looked up by filters that reach the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.cache import MB
from ledgerloom.sources.files import IMAGES

FOLDER = "application/folder"
#: The most folders of a listing, and of a listing shown on a console.
FOLDERS, SHOWN = 100, 20


def _there() -> Column:
    return ~F.coalesce(F.col("trashed"), F.lit(False))


def folder_images(files: DataFrame, parent: int) -> DataFrame:
    """Images of a folder that aren't in the bin. Filters on type and folder are pushed to the scan."""
    return files.where(F.col("mime").isin(*IMAGES) & (F.col("parent") == parent) & _there())


def folders(files: DataFrame, parent: int | None = None) -> DataFrame:
    """The first folders, of one parent if given; the listing has 100 and no second page."""
    found = files.where((F.col("mime") == FOLDER) & _there())
    return (found if parent is None else found.where(F.col("parent") == parent)).orderBy("file_id").limit(FOLDERS)


def is_photo(photo: str = "photo") -> Column:
    return F.col(photo).isNotNull()


def album_items(items: DataFrame, album: int) -> DataFrame:
    """Items of an album that have photo metadata."""
    return items.where((F.col("album_id") == album) & is_photo())


def albums(table: DataFrame) -> DataFrame:
    return table.select("album_id", F.coalesce("title", F.lit("Unknown")).alias("title"))


def album_sizes(table: DataFrame, items: DataFrame) -> DataFrame:
    """Items and images of every album; both count photos, so they are equal. Albums without any have 0."""
    n = items.where(is_photo()).groupBy("album_id").agg(F.count(F.lit(1)).alias("n"))
    got = F.coalesce("n", F.lit(0))
    return albums(table).join(n, "album_id", "left").select("album_id", "title", got.alias("total_items"), got.alias("image_items"))


def lookup(table: DataFrame, key: str, value: int, folder: bool = False) -> DataFrame:
    """The row of an id, no row without one; as a folder only if it is one."""
    found = table.where(F.col(key) == value)
    return (found.where(F.col("mime") == FOLDER) if folder else found).limit(1)


def media_url(base: Column, side: int | None = None) -> Column:
    """The address that an item is downloaded from, shrunk to a side if given."""
    return F.concat(base, F.lit(f"=w{side}-h{side}" if side else "=d"))


def old_files(files: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Files older than so many days: number and size. Nothing is removed."""
    old = files.where(F.col("cached_at") < F.lit(as_of) - F.make_dt_interval(F.lit(days)))
    freed = F.coalesce(F.sum("size"), F.lit(0))
    return old.agg(F.count(F.lit(1)).alias("n_files"), freed.alias("bytes"), F.round(freed / MB, 2).alias("mb"))
