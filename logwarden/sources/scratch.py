"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is written once and read soon: a dense codec, and row groups that keep a writer's memory small.
FORMAT = {"compression": "zstd", "parquet.block.size": str(32 << 20)}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Open scopes, innermost last. A thread has its own: it never deletes another's tables.
_scopes: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scopes", default=())


def scratch_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where none is configured a local session gets a new temporary one; on a cluster that would be a
    folder of one machine, and is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for what is written otherwise; scopes delete it like a table."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes.get()[-1:]:
        scope.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**FORMAT).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folders(spark: SparkSession, path: str, holding: str = "") -> list[str]:
    """Names of the folders in a folder of the shared store, of those that hold a file of that name if one is given."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    found = [s.getPath() for s in store.listStatus(place) if s.isDirectory()]
    return [p.getName() for p in found if not holding or store.exists(hadoop.Path(p, holding))]


def release(*frames: DataFrame) -> None:
    """Delete tables that materialise() wrote and nothing reads any more; other frames are left alone."""
    for frame in frames:
        path = _paths.pop(frame, None)
        if path:
            delete(frame.sparkSession, path)


@contextmanager
def temporary_tables(*keep: str) -> Iterator[None]:
    """Delete, at the end, the tables that this thread wrote inside, but for those whose name is in ``keep``."""
    outer, own = _scopes.get(), []
    opened = _scopes.set((*outer, own))
    try:
        yield
    finally:
        _scopes.reset(opened)
        for spark, path in own:
            if path.rsplit("/", 1)[-1].rsplit("-", 1)[0] not in keep:
                delete(spark, path)
            elif outer:
                outer[-1].append((spark, path))


def broadcast_if_small(df: DataFrame, name: str, most_rows: int) -> DataFrame:
    """Write a frame down; of up to ``most_rows`` rows, it is marked for broadcast, otherwise joins shuffle it."""
    stored = materialise(df, name)
    return F.broadcast(stored) if stored.count() <= most_rows else stored
