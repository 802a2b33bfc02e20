"""A library of files as a data source: pages of a listing are partitions, filters reach the pages.

A listing is a folder of Parquet pages below ``parent=<folder>``. A filter on the folder decides which pages are partitions at all; filters on the
type, the bin, the name and numbers are applied by the page's reader, so rows that fail them never reach Spark. Columns are those of the given schema.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from ledgerloom.cluster import ship
from ledgerloom.sources.files import IMAGES

NAME = "library_listing"
SCHEMA = "file_id long, name string, mime string, size long, cached_at timestamp, digest string, trashed boolean, parent long"
#: Rows of a page.
PAGE = 10_000
_HIVE = ds.partitioning(pa.schema([("parent", pa.int64())]), flavor="hive")


def write_pages(files: DataFrame, path: str, page: int = PAGE) -> None:
    """Writes a file table as a listing. A folder's files are spread over tasks, so a large folder is no single one; a file without a folder is in none and left out."""
    rows = files.where("parent IS NOT NULL").select("file_id", "name", "mime", "size", "cached_at", "digest", F.coalesce("trashed", F.lit(False)).alias("trashed"), F.col("parent").cast("long").alias("parent"))
    rows.repartition("parent", F.pmod(F.xxhash64("file_id"), F.lit(8))).write.option("maxRecordsPerFile", page).partitionBy("parent").mode("overwrite").parquet(path)


def _expression(f: D.Filter) -> pc.Expression | None:
    """A filter in the terms of a page's reader, None if it has none for it."""
    if isinstance(f, D.Not):
        inner = _expression(f.child)
        return None if inner is None else ~inner
    column = ds.field(f.attribute[0]) if len(f.attribute) == 1 else None
    if column is None:
        return None
    made = {
        D.EqualTo: lambda: column == f.value, D.In: lambda: column.isin([v for v in f.value if v is not None]), D.IsNotNull: lambda: column.is_valid(), D.IsNull: lambda: column.is_null(),
        D.GreaterThan: lambda: column > f.value, D.GreaterThanOrEqual: lambda: column >= f.value, D.LessThan: lambda: column < f.value, D.LessThanOrEqual: lambda: column <= f.value,
        D.StringStartsWith: lambda: pc.starts_with(column, pattern=f.value), D.StringEndsWith: lambda: pc.ends_with(column, pattern=f.value), D.StringContains: lambda: pc.match_substring(column, pattern=f.value),
    }
    return made[type(f)]() if type(f) in made else None


@dataclass
class Page(D.InputPartition):
    path: str


class ListingReader(D.DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema.fieldNames()
        self.wanted: pc.Expression | None = None

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            e = _expression(f)
            if e is None:
                yield f
            else:
                self.wanted = e if self.wanted is None else self.wanted & e

    def partitions(self) -> list[Page]:
        """Pages in folders that the filters leave; the others aren't opened."""
        listing = ds.dataset(self.path, format="parquet", partitioning=_HIVE, schema=self._schema())
        return [Page(f.path) for f in sorted(listing.get_fragments(self.wanted), key=lambda f: f.path)]

    def _schema(self) -> pa.Schema:
        kinds = {"long": pa.int64(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "boolean": pa.bool_()}
        return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        page = ds.dataset(partition.path, format="parquet", partitioning=_HIVE, schema=self._schema(), filesystem=None)
        for batch in page.to_batches(columns=self.columns, filter=self.wanted):
            if batch.num_rows:
                yield batch


class Listing(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options["path"].removeprefix("file://").removeprefix("file:"), schema)


def listing(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Files of a listing; give only the columns that are needed, as others aren't read then."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
    return spark.read.format(NAME).schema(columns).load(path)


def images_of(files: DataFrame, folder: int) -> DataFrame:
    """Images of a folder that aren't in the bin: three filters that the source takes."""
    return files.where(F.col("mime").isin(*IMAGES) & (F.col("parent") == folder) & ~F.col("trashed"))
