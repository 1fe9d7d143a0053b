"""Connected components of a distributed edge list: local forests first, then alternating star contraction."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import saved

EDGES = 500_000  # that a task holds at once


def local_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the edges (a, b); one batch's worth, in memory."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _forests(batches, most: int):
    """Edges (v, u) -> those of a forest that ties the same nodes together: each tied to the least that it reaches within `most` edges."""

    def forest(held):
        edges = pa.Table.from_batches(held)
        names, at = np.unique(np.concatenate([edges.column(0).to_numpy(), edges.column(1).to_numpy()]), return_inverse=True)
        root = local_forest(at[: len(edges)], at[len(edges) :], len(names))
        tied = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[tied]), pa.array(names[root[tied]])], ["v", "u"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield forest(held)
            held, n = [], 0
    if n:
        yield forest(held)


def _starred(now: DataFrame) -> bool:
    """Whether each node of the edges (v, u) has one edge to a smaller one, or none and only larger ones."""
    ends = now.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("u", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, max_rounds: int = 40, at_once: int = EDGES) -> DataFrame:
    """(node, root) for every node of the edges (a, b), longs; root: the smallest node it reaches.

    The driver holds the plan of every query, so queries are saved: edges become forests task by task, which settles what
    one task can hold, and stars are known as such without another round. Each round does a large and a small star and is
    written to the shared folder. The sums by node are partial before the shuffle and the joins are plain equi-joins that
    adaptive execution may split, so a hub with very many edges needs no task of its own. Edges from a node to itself and
    repeated edges don't matter; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    now, rounds = saved(pairs.mapInArrow(partial(_forests, most=at_once), "v long, u long"), "edges"), 0
    while not _starred(now):
        if (rounds := rounds + 1) > max_rounds:
            raise RuntimeError("components: no end within max_rounds")
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v has the neighbour u
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), F.least("v", "m").alias("m"))
        # large star: larger neighbours of each centre are tied to the least of its neighbourhood
        large = both.where("u > v").join(least, F.col("v") == F.col("c")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small star: each centre and its smaller neighbours are tied to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low.withColumnRenamed("v", "c"), F.col("v") == F.col("c"))
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        now = saved(small, "edges")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
