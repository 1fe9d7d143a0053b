"""Global and per-group ranks and running sums by DataFrame operations alone, without a task for a whole group.

Rows are dealt into buckets by the leading bits of a uniform order key. Bucket totals are summed up first (partial sums
before the shuffle), their running sums are taken over that small table, and only the rows inside one bucket are ordered
together. A group that holds a third of all rows is spread over as many buckets as any other rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import saved

STEP = 64  # buckets summed up together first


def unit(key: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53))


def running(df: DataFrame, group: list[str], bucket: Column, order: list[Column | str], sums: dict[str, str], totals: dict[str, str]) -> DataFrame:
    """df with, for each sums[new] = expression, the sum of the expression over the rows before in its group, and the group's totals[new].

    bucket (0..4095) must not decrease along order, and few rows may share one; group columns hold no nulls. Rows are dealt
    out by group and bucket together once, for the ranks inside a bucket and the join to the bucket totals. Those are summed up
    in two steps of STEP, so that no task orders more than STEP rows of a group.
    """
    df = df.withColumn("__bucket", bucket)
    key = [*group, "__bucket"]
    names = {v: f"__t{i}" for i, v in enumerate(dict.fromkeys([*sums.values(), *totals.values()]))}
    table = df.groupBy(*key).agg(*(F.sum(F.expr(v)).alias(n) for v, n in names.items())).withColumn("__wide", F.expr(f"__bucket div {STEP}"))
    before = lambda own, at: Window.partitionBy(*(own or [F.lit(0)])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    wide = table.groupBy(*group, "__wide").agg(*(F.sum(n).alias(n) for n in names.values()))
    every = Window.partitionBy(*(group or [F.lit(0)]))
    wide = wide.select(*group, "__wide", *(F.coalesce(F.sum(names[v]).over(before(group, "__wide")), F.lit(0)).alias(f"__w_{k}") for k, v in sums.items()), *(F.sum(names[v]).over(every).alias(k) for k, v in totals.items()))
    table = table.select(*key, "__wide", *(F.coalesce(F.sum(names[v]).over(before([*group, "__wide"], "__bucket")), F.lit(0)).alias(f"__b_{k}") for k, v in sums.items())).join(wide, [*group, "__wide"])
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.repartition(*key).select("*", *(F.coalesce(F.sum(F.expr(v)).over(inside), F.lit(0)).alias(f"__l_{k}") for k, v in sums.items()))
    joined = local.join(table, key)
    for k in sums:
        joined = joined.withColumn(k, F.col(f"__w_{k}") + F.col(f"__b_{k}") + F.col(f"__l_{k}"))
    return joined.drop("__bucket", "__wide", *(c for c in joined.columns if c.startswith(("__w_", "__b_", "__l_"))))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with a number from 0 among the rows that are equal in keys (no nulls), whatever their order.

    Rows are written first and numbered part by part; counts of the parts give what lies before, so no task holds all
    rows of a key.
    """
    parted = saved(df.withColumn("__part", F.spark_partition_id()), "numbered")
    own = [*keys, "__part"]
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    counts = parted.groupBy(*own).agg(F.count("*").alias("__n"))
    counts = counts.select(*own, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0)))
    return parted.withColumn(name, local).join(counts, own).withColumn(name, F.col("__before") + F.col(name) - 1).drop("__part", "__before")
