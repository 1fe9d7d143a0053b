"""Helpers shared by the operators: table reading, shared folders, column picking, bytes of text columns."""

from __future__ import annotations

import atexit
import math
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir as a URI; where it is unset (tests), one under the warehouse, set for checkpoint()."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        at = sc.getCheckpointDir()
    path, fs = _hadoop(spark, at)
    return fs.makeQualified(path).toString()  # a path without a scheme is one of the cluster's file system


def _hadoop(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def file_system(uri: str):
    """pyarrow file system and path of a URI; a path without a scheme could mean another machine's disk and is refused."""
    from pyarrow import fs

    if ":" not in uri:
        raise ValueError(f"{uri} has no scheme")
    return fs.FileSystem.from_uri(uri)


_MADE: list[tuple[int, str]] = []  # thread and folder, the newest last


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; nothing is created. What is there when the process ends, or drop_made() is called, is removed."""
    if not _MADE:
        atexit.register(_at_exit, spark)
    _MADE.append((threading.get_ident(), f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"))
    return _MADE[-1][1]


def made_here() -> list[str]:
    """The folders that this thread has made and that are still there, the newest last."""
    return [at for thread, at in _MADE if thread == threading.get_ident()]


def drop_made(spark: SparkSession, folders: list[str]) -> None:
    """Removes folders of made_here() once no DataFrame on them is needed any more."""
    for at in folders:
        path, fs = _hadoop(spark, at)
        fs.delete(path, True)
    gone = set(folders)
    _MADE[:] = [m for m in _MADE if m[1] not in gone]


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        drop_made(spark, [at for _, at in _MADE])


def saved(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, kind)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this write go when it ends
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage: its heap shrinks, and broadcasts and shuffles of earlier queries go. For loops of many queries."""
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """As many partitions as the estimated size of df asks for, at least the session's; those where the size isn't known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # from file sizes and the columns read
    known = size < 1 << 50  # joins and unknown sources are estimated far beyond any table
    return max(shuffle_partitions(df.sparkSession), math.ceil(size / bytes_each) if known else 0)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns under names of our own, so that no other column can clash."""
    return df.select(*(df[f"`{old}`"].alias(new) for new, old in cols.items()))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the len+1 offsets of its values; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def crc_fold(column, parts: int):
    """crc32 of a column's text form modulo parts: the fixed rule that splits rows into learning and held-out ones."""
    return F.crc32(column.cast("string").cast("binary")) % parts
