"""Small files and folder listings in any file system that Spark reaches."""

from __future__ import annotations

import fnmatch

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a whole file, over one that is there."""
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> bytes:
    """A whole file; for catalogues, not for data."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"])


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.delete(at, True)


def listing(spark: SparkSession, folder: str, *patterns: str, skip: tuple[str, ...] = ()) -> list[str]:
    """Paths below a folder, sorted, whose names fit a pattern in any case; folders named in ``skip`` are left out."""
    fs, at = _at(spark, folder)
    if not fs.exists(at):
        return []
    found, todo = [], [at]
    while todo:
        for s in fs.listStatus(todo.pop()):
            p = s.getPath()
            if s.isDirectory():
                if p.getName() not in skip:
                    todo.append(p)
            elif any(fnmatch.fnmatch(p.getName().lower(), x) for x in patterns):
                found.append(p.toString())
    return sorted(found)
