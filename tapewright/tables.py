"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import local_dir

_OPEN: list[list[str]] = []
_ROOTS: dict[str, str] = {}


def _root(spark) -> str:
    """The shared folder; where none is named, one temporary folder an application."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = local_dir(spark)
    return _ROOTS[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back, so that lineage ends there and what is read twice is made once. The file system deletes it
    when the application ends, scratch() sooner."""
    spark = df.sparkSession
    path = f"{_root(spark)}/tapewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(_path(spark, path))
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(make):
    """A function whose result is written; the other tables that it made by saved() are deleted when it returns or fails."""

    @functools.wraps(make)
    def made(*args, **named) -> DataFrame:
        _OPEN.append([])
        try:
            out = saved(make(*args, **named), make.__name__)
            kept = _OPEN[-1].pop()
        finally:
            spark = SparkSession.getActiveSession()
            for path in _OPEN.pop():
                _file_system(spark, path).delete(_path(spark, path), True)
        if _OPEN:
            _OPEN[-1].append(kept)
        return out

    return made
