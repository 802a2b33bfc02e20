"""What jobs need of the cluster: the folder that driver and executors share, and this package on the executors."""

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
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the checkpoint folder that the application has set.

    Only in a local session without either a temporary folder of our own takes its place; on a cluster executors couldn't read it, so there it is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[[^\[]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: for what several steps read, and to outlive executors."""
    path = new_path(df.sparkSession, tag)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Removes the files of a table from ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs started within remove their shuffle files as they end, not when the driver's collector finds them unused."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


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


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of what lies in a folder, by the cluster's own file system; empty where it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(at)) if fs.exists(at) else []
