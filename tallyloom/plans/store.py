"""Tables that several queries build on, written once per application and state of the folder's files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_paths: dict[tuple[str, str, int, str], str] = {}


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset (tests, one machine) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _state(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes with the names, lengths and times of the folder's files, by Spark's own file systems."""
    fs, where = _file_system(spark, sf_dir)
    out, todo = [], [where]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.isDirectory():
                todo.append(s.getPath())
            else:
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hash(tuple(sorted(out)))


def stored(spark: SparkSession, sf_dir: str, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """The table's Parquet form, written when it is first asked for; files that have changed since make it anew."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), name)
    if key not in _paths:
        path = new_folder(spark, name)
        made().write.parquet(path)
        _paths[key] = path
    return spark.read.parquet(_paths[key])


def release(spark: SparkSession) -> None:
    """Deletes the application's stored tables, once no query reads them any more; they are written again when asked for."""
    for key in [k for k in _paths if k[0] == spark.sparkContext.applicationId]:
        fs, where = _file_system(spark, _paths.pop(key))
        fs.delete(where, True)
