"""Folders of tables, wherever Spark can reach them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _found(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _found(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Nothing happens where there is none."""
    where, fs = _found(spark, path)
    fs.delete(where, True)
