"""Folders that driver and executors share: scratch tables, and what is there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; without that setting below the warehouse, and for a local session a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tessella-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = "file://" + _local[0]
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it again, so that later uses and lost executors don't compute it anew."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is absent."""
    fs, target = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []
