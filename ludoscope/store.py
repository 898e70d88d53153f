"""Small files in the folder that all share, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that appears whole or not at all: under another name first, then
    renamed. False if the name was taken, by whoever was first."""
    p, fs = _path(spark, path)
    draft, _ = _path(spark, f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.draft")
    fs.mkdirs(p.getParent())
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.exists(p) and fs.rename(draft, p):
        return True
    fs.delete(draft, False)
    return False


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder, if it is there."""
    p, fs = _path(spark, path)
    fs.delete(p, True)
