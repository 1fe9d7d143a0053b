"""Folders that all tasks can reach, for what is written in between; and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path under spark.checkpoint.dir, or the warehouse where that is unset (tests), as a URI; nothing is created."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path, files = _hadoop(spark, base)
    return f"{files.makeQualified(path).toString().rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, at: str) -> None:
    path, files = _hadoop(spark, at)
    files.delete(path, True)


def write_bytes(spark: SparkSession, at: str, data: bytes) -> None:
    """Writes a small file under another name and renames it over the old one in one step, so that one of both is always there."""
    path, files = _hadoop(spark, at)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fresh = hadoop.Path(f"{at}.new-{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write(bytearray(data))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(path), over)


def read_bytes(spark: SparkSession, at: str) -> bytes | None:
    """A small file as a whole; None where there is none."""
    path, files = _hadoop(spark, at)
    if not files.exists(path):
        return None
    source = files.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()
