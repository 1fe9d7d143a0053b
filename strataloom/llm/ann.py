"""Nearest neighbours by a hierarchical k-means tree, best bins first, with a calibrated number of leaf visits.

The tree is fitted on a bounded sample (a hundredth of the vectors, spread by a hash of their ids, between SAMPLE and
MOST_SAMPLED of them) and sent to all tasks; every vector is put into its leaf. A query walks the tree through a priority
queue of nodes ordered by the distance to their centres and so gets its leaves in best-bin-first order. How many it visits is
calibrated: for CALIBRATION queries the exact neighbours are found among all vectors, and the number of visits is widened
until the leaves hold TARGET of them; as many other queries then measure the recall, and visits are widened on until it is at
least LEAST there too. All leaves are exact search.

Leaves that lie side by side in the tree make up shards of at most SHARD bytes; a larger leaf is several shards. Each vector
is shuffled once, to its shard, and each query once to every shard in which it has leaves to visit, with their numbers. A
task holds one shard at a time and lets its queries stream by, keeping the best of each; so neither blocks of vectors nor
of queries are multiplied. Distances of candidates are exact and in double precision; a product of matrices with an error
bound says which are worth computing.

Equal vectors are searched as one: only the k + 1 smallest ids of a vector can be in any answer, and they are gathered
task by task before the shuffle. So neither a very common vector nor a leaf that can't be divided makes a hot shard.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, neither do null ids; ties go to the smaller id; rows that repeat an id and a vector are one candidate, and a query's
own id is never its candidate; fewer candidates than k give them all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import pick, saved, shuffle_partitions, table

SAMPLE, MOST_SAMPLED = 20_000, 200_000
BRANCH = 8
LEAF = 64  # sampled vectors below which a node isn't divided
CALIBRATION = 128
TARGET, LEAST = 0.97, 0.93
SHARD = 16 << 20  # bytes of vectors that a task holds
QUERIES = 64  # compared with a shard at a time


@dataclass
class Tree:
    """Node 0 is the root; children[i] lists nodes, empty for leaves; leaf[i] numbers the leaves."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector, by the nearest centre at every step down."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            nearest = squared(x[rows], self.centres[self.children[node]]).argmin(1)
            todo += [(child, rows[nearest == k]) for k, child in enumerate(self.children[node]) if (nearest == k).any()]
        return out

    def order(self, query: np.ndarray, visits: int) -> list[int]:
        """The first `visits` leaves, best bins first."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            while self.children[node]:  # down to the nearest leaf; the siblings wait in the queue
                kids = self.children[node]
                d = ((self.centres[kids] - query) ** 2).sum(1)
                best = int(d.argmin())
                for k, child in enumerate(kids):
                    if k != best:
                        heapq.heappush(heap, (float(d[k]), child))
                node = kids[best]
            out.append(self.leaf[node])
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the expanded form; for choosing centres only."""
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres, squared(x, centres).argmin(1)


def fit(x: np.ndarray, seed: int = 3) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree(x.mean(0, keepdims=True) if len(x) else np.zeros((1, 1)), [[]], [-1])
    centres, todo = [tree.centres[0]], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) > LEAF:
            found, near = kmeans(x[rows], BRANCH, rng)
            parts = [rows[near == k] for k in range(BRANCH)]
            if sum(len(p) > 0 for p in parts) > 1:
                for k, part in enumerate(parts):
                    if len(part):
                        tree.children[node].append(len(centres))
                        centres.append(found[k])
                        tree.children.append([])
                        tree.leaf.append(-1)
                        todo.append((len(centres) - 1, part))
    for number, node in enumerate(n for n, kids in enumerate(tree.children) if not kids):
        tree.leaf[node] = number
    tree.centres = np.array(centres)
    return tree


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a valid vector, their vectors as doubles)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.array(pc.list_value_length(column).fill_null(-1)) if len(column) else np.zeros(0, int)
    if dim is None:
        dim = int(np.bincount(size[size > 0]).argmax()) if (size > 0).any() else 0
    rows = np.flatnonzero((size == dim) & (dim > 0))
    values = np.array(column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), dim)
    good = np.isfinite(values).all(1) & (values != 0).any(1)
    return rows[good], values[good]


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances in double precision, component by component."""
    out = np.empty((len(queries), len(vectors)))
    for i, q in enumerate(queries):
        out[i] = np.sqrt(((vectors - q) ** 2).sum(1))
    return out


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int, open_: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the vectors among its k nearest (of those open to it), with all that tie with the last, and their exact distances."""
    if not len(vectors):
        return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    with np.errstate(over="ignore", invalid="ignore"):
        own, other = (queries**2).sum(1), (vectors**2).sum(1)
        about = other[None] - 2 * queries @ vectors.T
        about += own[:, None]
    slack = 4e-15 * (vectors.shape[1] + 8) * (own + other.max())  # several times what rounding can do
    about[~np.isfinite(about)] = 0.0  # too large to tell: to be computed
    if open_ is not None:
        about[~open_] = np.inf
    out = []
    for q, row, more in zip(queries, about, np.nan_to_num(slack, posinf=np.finfo(float).max), strict=True):
        far = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
        near = np.flatnonzero((row <= far + 2 * more) & (row < np.inf))
        d = np.sqrt(((vectors[near] - q) ** 2).sum(1))
        if len(near) > k:
            best = d <= np.partition(d, k - 1)[k - 1]
            near, d = near[best], d[best]
        out.append((near, d))
    return out


def merged(whose: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((whose, dist))[:k]
    return whose[order], dist[order]


VECTORS = "vector binary, ids array<long>"


def distinct_vectors(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """vector (its doubles as bytes) and the k + 1 smallest ids that have it."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column(1), dim)
            doc = batch.column(0).to_numpy()[at]
            held: dict[bytes, list[int]] = {}
            for i in np.argsort(doc, kind="stable"):
                own = held.setdefault(x[i].tobytes(), [])
                if len(own) <= k and (not own or own[-1] != doc[i]):
                    own.append(int(doc[i]))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["vector", "ids"])

    some = rows.mapInArrow(gather, VECTORS)
    merged = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)  # at most k + 1 ids a batch
    return some.groupBy("vector").agg(merged.alias("ids"))


def doubles(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def shards_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each leaf and the number of its shards; neighbouring leaves share one while they fit."""
    first, parts, at, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, 0
    for leaf, n in enumerate(sizes):
        if n > room:
            at, room = at + 1, most
        first[leaf] = at
        if n > most:
            parts[leaf] = -(-n // most)
            at, room = at + parts[leaf] - 1, 0
        else:
            room -= n
    return first, parts


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> tuple[DataFrame, dict]:
    """(query_id, rank, vec_id, score) for each valid query row, and what was calibrated: leaves, visits, recall."""
    spark = rows.sparkSession
    rows = pick(rows, id=id_col, vector=vector_col).where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "vector")
    queries = pick(queries, id=id_col, vector=vector_col).where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "vector")
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema), {"leaves": 0, "visits": 0, "recall": 1.0}
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    sampled = min(MOST_SAMPLED, max(SAMPLE, n // 100))
    sample = pa.Table.from_batches(rows.orderBy(F.xxhash64("id"), "id").limit(sampled).select("vector").toArrow().to_batches())
    tree = fit(np.unique(matrix(sample.column(0), dim)[1], axis=0))
    sent = spark.sparkContext.broadcast(tree)  # at most about MOST_SAMPLED / LEAF * 2 centres

    def place(batches):
        for batch in batches:
            x = doubles(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.assign(x)), *batch.columns], ["leaf", "vector", "ids"])

    indexed = saved(distinct_vectors(rows, dim, k).mapInArrow(place, f"leaf long, {VECTORS}"), "ann-index")

    def as_bytes(batches):
        for batch in batches:
            at, x = matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[at]), pa.array([v.tobytes() for v in x], pa.binary())], ["query_id", "vector"])

    wanted = saved(queries.mapInArrow(as_bytes, "query_id long, vector binary").distinct(), "ann-queries")
    asked = saved(wanted.select("vector").distinct(), "ann-asked")
    visits, recall = calibrate(indexed, asked, tree, k, target)
    held = np.zeros(max(1, tree.leaves), np.int64)
    for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # a row a leaf of the tree
        held[r["leaf"]] = r["n"]
    first, parts = shards_of(held, max(1, SHARD // (8 * dim)))
    met = "shard long, asks boolean, leaf long, vector binary, ids array<long>, leaves array<int>"
    names = ["shard", "asks", "leaf", "vector", "ids", "leaves"]

    def deal(batches):
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            part = np.array([zlib.crc32(v) for v in batch.column(1).to_pylist()], np.int64) % parts[leaf]
            none = pa.nulls(len(leaf), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(first[leaf] + part), pa.array(np.zeros(len(leaf), bool)), *batch.columns, none], names)

    def walk(batches):
        for batch in batches:
            for vector, q in zip(batch.column(0).to_pylist(), doubles(batch.column(0)), strict=True):
                by_shard: dict[int, list[int]] = {}
                for leaf in sent.value.order(q, visits):
                    for shard in range(first[leaf], first[leaf] + parts[leaf]):
                        by_shard.setdefault(shard, []).append(leaf)
                m = len(by_shard)
                yield pa.RecordBatch.from_arrays([pa.array(list(by_shard), pa.int64()), pa.array([True] * m), pa.nulls(m, pa.int64()), pa.array([vector] * m, pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.array(list(by_shard.values()), pa.list_(pa.int32()))], names)

    def compare(batches):
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # of this task, so that the shuffle after it is small
        shard, blocks, ready = None, [], None

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.binary()), pa.array([x[0] for x in best.values()], pa.list_(pa.int64())), pa.array([x[1] for x in best.values()], pa.list_(pa.float64()))], ["vector", "ids", "scores"])
            best.clear()

        for batch in batches:
            number, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])]) if len(number) else []
            for lo, hi in zip(cut, [*cut[1:], len(number)], strict=True):
                own = batch.slice(lo, hi - lo)
                if number[lo] != shard:
                    shard, blocks, ready = number[lo], [], None
                if not asks[lo]:
                    blocks.append((own.column(2).to_numpy(), doubles(own.column(3)), own.column(4).flatten().to_numpy(), own.column(4).value_lengths().to_numpy()))
                    continue
                if not blocks:
                    continue
                if ready is None:
                    leaf, x, ids, size = (np.concatenate([b[i] for b in blocks]) for i in range(4))
                    leaves, at = np.unique(leaf, return_inverse=True)
                    ready, blocks = (leaves, at, x, ids, np.r_[0, np.cumsum(size)]), [()]
                leaves, at, x, ids, start = ready
                for a in range(0, own.num_rows, QUERIES):
                    some = own.slice(a, QUERIES)
                    visited = np.zeros((some.num_rows, len(leaves)), bool)
                    which = np.repeat(np.arange(some.num_rows), some.column(5).value_lengths().to_numpy())
                    to = some.column(5).flatten().to_numpy()
                    place = np.minimum(np.searchsorted(leaves, to), len(leaves) - 1)
                    there = leaves[place] == to
                    visited[which[there], place[there]] = True
                    for vector, (near, d) in zip(some.column(3).to_pylist(), nearest(doubles(some.column(3)), x, k + 1, visited[:, at]), strict=True):
                        count = start[near + 1] - start[near]
                        whose = ids[np.repeat(start[near] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())] if len(near) else near
                        dist = np.repeat(d, count)
                        if (old := best.get(vector)) is not None:
                            whose, dist = np.concatenate([old[0], whose]), np.concatenate([old[1], dist])
                        best[vector] = merged(whose, dist, k + 1)
                if len(best) > 20_000:
                    yield from flush()
        if best:
            yield from flush()

    both = indexed.mapInArrow(deal, met).unionByName(asked.mapInArrow(walk, met))
    found = both.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "asks").mapInArrow(compare, "vector binary, ids array<long>, scores array<double>")
    # each task gives at most k + 1 of a query now and then; the best of them for each query
    every = F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list(F.zip_with("scores", "ids", lambda s, i: F.struct(s.alias("score"), i.alias("vec_id"))))))), 1, k + 1)
    best = found.groupBy("vector").agg(every.alias("best"))
    answers = wanted.join(best, "vector").select("query_id", "best")  # a plain join: a vector that very many queries have may be split
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
    return answers, {"leaves": tree.leaves, "visits": visits, "recall": recall}


def calibrate(indexed: DataFrame, asked: DataFrame, tree: Tree, k: int, target: float) -> tuple[int, float]:
    """Visits at which a bounded sample of queries reaches the target, against all vectors, and the recall of as many others there."""
    some = [r["vector"] for r in asked.orderBy(F.xxhash64("vector")).select("vector").limit(2 * CALIBRATION).collect()]
    if not some:
        return 1, 1.0
    x = np.frombuffer(b"".join(some), np.float64).reshape(len(some), -1)
    sent = indexed.sparkSession.sparkContext.broadcast(x)  # 2 * CALIBRATION vectors

    def exact(batches):
        top = [(np.zeros(0), np.zeros(0, np.int64))] * len(sent.value)
        for batch in batches:
            leaf, vectors = batch.column(0).to_numpy(), doubles(batch.column(1))
            for lo in range(0, len(top), QUERIES):
                for i, (near, d) in enumerate(nearest(sent.value[lo : lo + QUERIES], vectors, k + 1), lo):
                    dist, of = np.concatenate([top[i][0], d]), np.concatenate([top[i][1], leaf[near]])
                    order = np.argsort(dist, kind="stable")[: k + 1]
                    top[i] = dist[order], of[order]
        if any(len(d) for d, _ in top):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(top)), [len(d) for d, _ in top])), pa.array(np.concatenate([d for d, _ in top])), pa.array(np.concatenate([of for _, of in top]))], ["q", "d", "leaf"])

    found = indexed.mapInArrow(exact, "q long, d double, leaf long")
    close = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "leaf"))), 1, k + 1).alias("near")).collect()  # 2 * CALIBRATION rows
    need: tuple[list[int], list[int]] = ([], [])
    for r in close:
        at = {leaf: i for i, leaf in enumerate(tree.order(x[r["q"]], tree.leaves))}
        need[r["q"] % 2 if len(some) > 1 else 0].extend(at[n["leaf"]] + 1 for n in r["near"])
    fitted, others = np.array(need[0]), np.array(need[1] or need[0])
    visits = tree.leaves if target >= 1 else 1  # a target of 1 is exact search
    while visits < tree.leaves and ((fitted <= visits).mean() < target or (others <= visits).mean() < min(LEAST, target)):  # widened step by step
        visits = min(tree.leaves, max(visits + 1, int(visits * 1.25)))
    return visits, float((others <= visits).mean())


def op1(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found, facts = search(rows, rows.where(F.col("vec_id") % 100 == 0))
    return found.withColumn("visits", F.lit(facts["visits"])).withColumn("leaves", F.lit(facts["leaves"]))
