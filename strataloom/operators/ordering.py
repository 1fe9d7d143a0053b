"""Seeded, portable row order and global row numbers without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 1 << 32
BUCKETS = 1 << 12


def shuffle_key(id_col: str | Column, seed: int, epoch: int = 0) -> Column:
    """0..2**32-1, the leading bits of the MD5 sum of seed, epoch and id: even whatever the ids are, the same in any engine."""
    of = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), of.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def shuffle_key_sql(id_col: str, seed: int, epoch: int = 0) -> str:
    """The same key in DuckDB's SQL."""
    return f"('0x' || substr(md5('{seed}:{epoch}:' || {id_col}), 1, 8))::bigint"


def with_position(df: DataFrame, key: Column, tie: str, name: str = "position") -> DataFrame:
    """df with its 0-based place in the order of (key, tie); key: a shuffle_key.

    Rows are numbered inside buckets of the key's leading bits; the buckets' own counts (BUCKETS rows at most) give what
    lies before each. The key is a hash, so buckets are even.
    """
    df = df.withColumn("__key", key).withColumn("__bucket", F.floor(F.col("__key") / (MODULUS // BUCKETS)).cast("int"))
    counts = df.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = counts.select("__bucket", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", tie))
    # before has at most BUCKETS rows
    return df.join(F.broadcast(before), "__bucket").withColumn(name, F.col("__before") + inside - 1).drop("__key", "__bucket", "__before")
