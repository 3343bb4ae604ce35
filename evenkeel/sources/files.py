"""Folders that the driver and all executors share, through Spark's own file systems."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

_OWN: list[str] = []


def at(spark: SparkSession, path: str):
    """A path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = at(spark, path)
    return fs.exists(p)


def make(spark: SparkSession, path: str) -> None:
    fs, p = at(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = at(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Of what lies in a folder; none if it isn't there."""
    fs, p = at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in another's place."""
    fs, p = at(spark, target)
    fs.delete(p, True)
    fs.mkdirs(p.getParent())
    if not fs.rename(at(spark, source)[1], p):
        raise OSError(f"{source} can't be moved to {target}")


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the driver's Python ends; a temporary one where that is unset on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=f"spark-{name}-")
    if not _OWN:
        atexit.register(_deleted)
    _OWN.append(path)
    return path


def _deleted() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        spark = SparkSession(context)
        for path in _OWN:
            delete(spark, path)
