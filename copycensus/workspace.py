"""Shared storage: where intermediate tables live, and the few file calls that jobs need.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, so a lost executor costs
a re-read of a stored file and never a second pass over the data.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


_scope: ContextVar[str | None] = ContextVar("scratch", default=None)


@lru_cache(maxsize=None)
def _local_folder(application_id: str) -> str:
    return "file:" + tempfile.mkdtemp(prefix=f"copycensus-{application_id}-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode with none set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder(sc.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, in a folder of this application that its end removes.

    Inside ``scratch_scope`` the path is below the folder of the scope, and goes with it.
    """
    if scope := _scope.get():
        return f"{scope}/{label}-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    fs, p = _file_system(spark, folder)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession, label: str) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end, so results must be stored elsewhere."""
    folder = scratch_path(spark, label)
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, folder)


def snapshot(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` as Parquet in the shared folder and return the stored table.

    Used where several consumers would otherwise each repeat the work that leads to ``df``.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_committed(spark: SparkSession, path: str) -> bool:
    """True if a Spark write to ``path`` finished."""
    fs, p = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, p = _file_system(spark, path)
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, new: str) -> None:
    """Give a file a new name that nothing has."""
    fs, p = _file_system(spark, path)
    if not fs.rename(p, _file_system(spark, new)[1]):
        raise OSError(f"cannot move {path} to {new}")


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, p = _file_system(spark, path)
    fs.create(p, True).close()


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put the finished folder ``new`` in the place of ``path``; what was there goes last."""
    fs, p = _file_system(spark, path)
    source = _file_system(spark, new)[1]
    old = _file_system(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    fs.mkdirs(p.getParent())
    had = fs.exists(p)
    if had and not fs.rename(p, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(source, p):
        if had:
            fs.rename(old, p)
        raise OSError(f"cannot move {new} to {path}")
    if had:
        fs.delete(old, True)
