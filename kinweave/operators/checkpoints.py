"""Lineage cuts: tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder of spark.checkpoint.dir, or of a temporary one in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kinweave-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return (found if "://" in found else "file://" + found.removeprefix("file:")).rstrip("/")


def own_dir(spark: SparkSession, name: str) -> str:
    """The URI of a new folder below the shared one."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it from there: any executor can, whoever wrote it."""
    path = own_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, since: int = 0) -> None:
    """Deletes the folders made so far in this process, from the given number on, when no result is to be read any more."""
    jvm = spark.sparkContext._jvm
    while len(_MADE) > since:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables made inside are deleted at its end: results have to be written, or collected, before."""
    since = len(_MADE)
    try:
        yield
    finally:
        remove_tables(spark, since)
