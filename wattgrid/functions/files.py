"""Small files in the folders that all executors share, by Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries, in order; none where there is no folder."""
    path, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_text(spark: SparkSession, name: str) -> str:
    path, fs = _path(spark, name)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """A file that is there as a whole or not at all: it is written under another name first."""
    path, fs = _path(spark, name)
    part, _ = _path(spark, f"{name}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    if not fs.rename(part, path):
        raise FileExistsError(name)


def delete(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)
