"""Derived tables kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, object] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, and on a local master, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> str:
    """Changes when files of the path do: their number, sizes and times."""
    where, fs = _file_system(spark, path)
    found = fs.globStatus(where)
    summary = [(s.getLen(), s.getModificationTime()) for s in found or []]
    for s in found or []:
        if s.isDirectory():
            summary += [(x.getLen(), x.getModificationTime()) for x in fs.listStatus(s.getPath())]
    return str(hash(tuple(sorted(summary))))


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{len(_MADE)}"
    _MADE.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder and read back; removed when the driver's Python ends."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, key: tuple, make: Callable[[], object]) -> object:
    """A value made once a Spark application for each key."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _KEPT:
        _KEPT[full] = make()
    return _KEPT[full]


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            where, fs = _file_system(spark, path)
            fs.delete(where, True)
        except Exception:  # the JVM is already gone
            return
