"""Small file operations through Spark's own file system layer: any store that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def matching(spark: SparkSession, pattern: str, folders: bool = False) -> list[str]:
    """Files (or folders) that match the pattern; none where nothing does."""
    fs, p = _path(spark, pattern)
    return [s.getPath().toString() for s in (fs.globStatus(p) or []) if s.isDirectory() == folders]


def delete(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all in it; nothing happens if it is not there."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in place of what stands there: written beside it and renamed, so readers see the old or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    fs, p = _path(spark, beside)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(p, jvm.org.apache.hadoop.fs.Path(path), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
