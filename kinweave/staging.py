"""Intermediate tables in the folder that driver and executors share.

Every table gets a folder of its own under kinweave/<application>. A Scope owns the folders that are made inside of its with block, in
this thread and no other, and is the only one that deletes them; what it leaves belongs to the scope around it. What no scope
deletes goes when the driver ends, as the application's folder is marked for that.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_current: ContextVar[Scope | None] = ContextVar("kinweave_scope", default=None)
_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one, which serves local masters alone."""
    with _lock:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="kinweave-")
            spark.conf.set("spark.checkpoint.dir", folder)
        return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def application_folder(spark: SparkSession) -> str:
    """Made on first use, and deleted by the file system when the driver ends."""
    root = f"{shared_folder(spark)}/kinweave/{spark.sparkContext.applicationId}"
    where, files = _file_system(spark, root)
    with _lock:
        if not files.exists(where):
            files.mkdirs(where)
            files.deleteOnExit(where)
    return root


def delete(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)


class Scope:
    """with Scope(spark) as scope: folders made inside are scope.paths, in order. An error deletes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        self._outer = _current.get()
        self._token = _current.set(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _current.reset(self._token)
        if kind is not None:
            self.drop()
        elif self._outer is not None:
            self._outer.paths += self.paths

    def drop(self, keep: int = 0) -> None:
        """Deletes all folders but the newest few. Frames that read them are of no use from then on."""
        going = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(going) :]
        for path in going:
            delete(self.spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (scope := _current.get()) is not None:
        scope.paths.append(path)
    return path


#: Steps of more rows join by sorted shuffles alone.
FEW_ROWS = 100_000


def joined(rows: int) -> Callable[[DataFrame], DataFrame]:
    """How a step of so many rows marks what it joins. A table is sent to all through the driver where it is small as a file, and
    files of keys are small up to a million rows; in a step of many joins or rounds that sum grows with the input. So only few rows may be.
    """
    return (lambda df: df.hint("merge")) if rows > FEW_ROWS else (lambda df: df)


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    """df written to the shared folder and read back: loops keep short plans that outlive executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
