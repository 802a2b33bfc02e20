"""What the operators share: the cluster's shared folder, written tables and shipped code."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
_open: dict[str, DataFrame] = {}  # tables of ``stored`` that aren't dropped yet, by path
_owner: ContextVar[list[DataFrame] | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset in a local session a temporary folder of our own takes its place; on a
    cluster executors couldn't read it, so there it is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[[^\[]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, and outlives executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.partitionBy(*partition_by).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    _open[path] = made
    if (own := _owner.get()) is not None:
        own.append(made)
    return made


@contextmanager
def owning() -> Iterator[list[DataFrame]]:
    """The tables that ``stored`` makes within, here and not in other threads: theirs to drop is whoever asked for them."""
    token = _owner.set(tables := [])
    try:
        yield tables
    finally:
        _owner.reset(token)


def held(spark: SparkSession) -> dict[str, DataFrame]:
    """Tables of ``stored`` in this application that aren't dropped yet, by path."""
    return {path: df for path, df in _open.items() if df.sparkSession.sparkContext is spark.sparkContext}


def drop(*tables: DataFrame) -> None:
    """Removes the files of tables from ``stored`` that nothing reads any more.

    Shuffle files of finished steps go only when the driver's collector finds them unused, which a driver with
    little to do hardly ever starts by itself, so that is asked for, too.
    """
    tables = tuple(df for df in tables if df.stored_at in _open)
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        _open.pop(df.stored_at, None)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def tidy() -> None:
    """Gives memory that a task of a Python worker freed back to the system: workers are kept for later tasks."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f"{_PACKAGE.name}/{f.relative_to(_PACKAGE)}")
    folder = tempfile.mkdtemp(prefix="ledgerloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, f"{_PACKAGE.name}-{uuid.uuid4().hex[:8]}.zip")
    Path(at).write_bytes(data.getvalue())
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
