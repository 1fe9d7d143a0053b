"""Boosting with flat hash partitions: b threshold tests put a row into one of 2**b buckets, each with a logit a class.

One batch adds one hash. All earlier hashes are updated with the same residuals, taken before the batch changes anything;
their sums add to what they hold. Every step is data-parallel: each task sums residuals and Hessians of its rows by
(round, bucket, class) in NumPy with the model at hand and sends only visited cells, as arrays; sums of sums are made round
by round, and the model (rounds x 2**b x classes) is updated on the driver. The pairs that define a new hash come from the
hardest rows: a top-k by cross-entropy (to nine places, so that ties go by id whatever the order of additions), doubled until
there are enough pairs of different classes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.boosting import DENOMINATOR_FLOOR, HESSIAN_FLOOR, pick_feature, uniform_logits


def pair_up(labels: list[int], num_pairs: int) -> tuple[list[tuple[int, int]], int]:
    """Pairs of positions with different labels, scanning in order and wrapping round; also how far the scan came.

    Waiting positions share one class. A position of another class is paired with the one that waits longest; one of the
    same class waits too while the waiting and the pairs found are fewer than num_pairs, and is passed over otherwise.
    """
    if len(set(labels)) < 2:
        raise ValueError("pairs need at least two classes in the batch")
    found: list[tuple[int, int]] = []
    waiting: deque[int] = deque()
    at = 0
    while len(found) < num_pairs:
        i = at % len(labels)
        if waiting and labels[waiting[0]] != labels[i]:
            found.append((waiting.popleft(), i))
        elif len(waiting) + len(found) < num_pairs:
            waiting.append(i)
        at += 1
    return found, at


def features_matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class HashModel:
    """Splits never change; g and h hold all batches since a hash was made; leaves follow from them."""

    num_classes: int
    bits: int
    lr: float
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    midpoints: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    g: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0)))
    h: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0)))

    def __post_init__(self):
        if not len(self.features):
            self.features, self.midpoints = np.zeros((0, self.bits), np.int64), np.zeros((0, self.bits))
            self.g = np.zeros((0, 1 << self.bits, self.num_classes))
            self.h = self.g.copy()

    @property
    def rounds(self) -> int:
        return len(self.features)

    @property
    def leaves(self) -> np.ndarray:
        return self.g / (self.h + DENOMINATOR_FLOOR) * self.lr

    def buckets(self, x: np.ndarray, r: int) -> np.ndarray:
        return (x[:, self.features[r]] <= self.midpoints[r]) @ (1 << np.arange(self.bits))

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.num_classes))
        leaves = self.leaves
        for r in range(self.rounds):
            out += leaves[r, self.buckets(x, r)]
        return out

    def stages(self, x: np.ndarray) -> np.ndarray:
        """[rounds + 1, rows, classes] logits of each round alone; the first are those of equal classes."""
        leaves = self.leaves
        first = np.tile(uniform_logits(self.num_classes), (len(x), 1))
        return np.stack([first, *(leaves[r, self.buckets(x, r)] for r in range(self.rounds))])

    def add(self, features: list[int], midpoints: list[float]) -> None:
        self.features = np.vstack([self.features, np.array(features, np.int64)[None]])
        self.midpoints = np.vstack([self.midpoints, np.array(midpoints, float)[None]])
        cell = np.zeros((1, 1 << self.bits, self.num_classes))
        self.g, self.h = np.concatenate([self.g, cell]), np.concatenate([self.h, cell])


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class HashBoost:
    """num_pairs: tests, and so bits, of a hash. picker(round, bit, num_features): the feature of each test."""

    def __init__(self, num_classes: int, num_pairs: int = 8, lr: float = 0.1, max_hashes: int = 100, seed: int = 0, picker: Callable[[int, int, int], int] | None = None):
        if num_classes < 2 or num_pairs < 1 or max_hashes < 1:
            raise ValueError("at least two classes, one pair and one hash are needed")
        self.model = HashModel(num_classes, num_pairs, lr)
        self.max_hashes = max_hashes
        self.picker = picker or (lambda r, b, p: pick_feature(seed, r, b, p))

    # training

    def fit_batch(self, batch: DataFrame) -> HashBoost:
        """Updates all hashes with a batch (id, features, label) and adds one."""
        if self.model.rounds >= self.max_hashes:
            raise ValueError(f"all {self.max_hashes} hashes are used")
        return self._step(batch, new=True)

    def update(self, batch: DataFrame) -> HashBoost:
        """Updates all hashes with a batch (id, features, label) and adds none."""
        return self._step(batch, new=False)

    def _step(self, batch: DataFrame, new: bool) -> HashBoost:
        rows = batch.select("id", F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"))
        scored = self._scored(rows).persist()
        try:
            facts = scored.agg(F.min("label"), F.max("label"), F.countDistinct("label"), F.count("*"), F.max(F.size("features"))).first()
            if new and (not facts[3] or facts[2] < 2):
                raise ValueError("a batch needs rows of at least two classes")
            if facts[3] and (facts[0] < 0 or facts[1] >= self.model.num_classes):
                raise ValueError(f"labels must be 0..{self.model.num_classes - 1}")
            if new:
                self.model.add(*self._new_hash(scored, int(facts[3]), int(facts[4])))
            sums = self._sums(scored)
        finally:
            scored.unpersist()
        for r, cells, g, h in sums:
            self.model.g[r].ravel()[cells] -= g
            self.model.h[r].ravel()[cells] += h
        return self

    def _scored(self, rows: DataFrame) -> DataFrame:
        """rows with the probabilities under the model as it is, and their cross-entropy."""
        sent = rows.sparkSession.sparkContext.broadcast(self.model)  # rounds x 2**bits x classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    p = softmax_rows(sent.value.logits(features_matrix(b.column(1))))
                    y = b.column(2).to_numpy()
                    ok = (y >= 0) & (y < p.shape[1])
                    ce = -np.log(np.where(ok, p[np.arange(len(y)), np.where(ok, y, 0)], 1.0))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(p), pa.list_(pa.float64())), pa.array(ce)], ["id", "features", "label", "proba", "ce"])

        return rows.mapInArrow(run, "id long, features array<double>, label int, proba array<double>, ce double")

    def _new_hash(self, scored: DataFrame, n: int, num_features: int) -> tuple[list[int], list[float]]:
        """Tests from pairs of the hardest rows."""
        want, wanted = self.model.bits, 4 * self.model.bits
        while True:
            top = scored.orderBy(F.desc(F.round("ce", 9)), "id").limit(min(wanted, n)).select("id", "label").collect()  # a top-k, widened if it holds too few pairs
            labels = [r["label"] for r in top]
            if len(set(labels)) > 1:
                pairs, came = pair_up(labels, want)
                if came <= len(labels) or len(labels) == n:
                    break
            wanted *= 2
        chosen = sorted({i for p in pairs for i in p})
        x = {r["id"]: r["features"] for r in scored.where(F.col("id").isin([top[i]["id"] for i in chosen])).select("id", "features").collect()}  # at most 2 rows a pair
        features = [self.picker(self.model.rounds, bit, num_features) for bit in range(want)]
        return features, [(x[top[a]["id"]][f] + x[top[b]["id"]][f]) / 2 for f, (a, b) in zip(features, pairs, strict=True)]

    def _sums(self, scored: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Residual and Hessian sums of all hashes, the new one among them: (round, cells visited, their sums), a cell being bucket * classes + class.

        A task goes through the hashes one by one and sends one row of arrays for each, so neither it nor the driver holds
        more than the cells that rows fall into.
        """
        sent = scored.sparkSession.sparkContext.broadcast(self.model)
        schema = "round int, cells array<long>, g array<double>, h array<double>"
        names = ["round", "cells", "g", "h"]

        def summed(cells: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own, at = np.unique(cells, return_inverse=True)
            return own, np.bincount(at, g, len(own)), np.bincount(at, h, len(own))

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            r, cells, g, h = zip(*rows, strict=True) if rows else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(cells, pa.list_(pa.int64())), pa.array(g, pa.list_(pa.float64())), pa.array(h, pa.list_(pa.float64()))], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, k = sent.value, sent.value.num_classes
            held = [(features_matrix(b.column(1)), b.column(2).to_numpy(), features_matrix(b.column(3))) for b in batches if b.num_rows]
            if not held:
                return
            x, y, p = (np.concatenate([h[i] for h in held]) for i in range(3))
            residual, hessian = p.copy(), p * (1 - p) + HESSIAN_FLOOR
            residual[np.arange(len(y)), y] -= 1
            for r in range(model.rounds):
                cells = model.buckets(x, r)[:, None] * k + np.arange(k)
                yield as_batch([(r, *summed(cells.ravel(), residual.ravel(), hessian.ravel()))])

        def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            flat = [table.column(c).combine_chunks().flatten().to_numpy() for c in names[1:]]
            return pa.Table.from_batches([as_batch([(key[0].as_py(), *summed(*flat))])])

        made = scored.select("id", "features", "label", "proba").mapInArrow(run, schema)
        found = made.groupBy("round").applyInArrow(merge, schema).toArrow()  # the visited part of the model, a row a round
        return [(found.column(0)[i].as_py(), *(found.column(c)[i].values.to_numpy() for c in names[1:])) for i in range(found.num_rows)]

    # prediction

    def _mapped(self, df: DataFrame, fn: Callable[[HashModel, np.ndarray], np.ndarray], name: str) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.model)
        at, old = df.columns.index("features"), [c for c in df.columns if c != name]
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in old) + f", `{name}` array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    got = fn(sent.value, features_matrix(b.column(at)))
                    yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in old), pa.array(list(got), pa.list_(pa.float64()))], [*old, name])

        return df.mapInArrow(run, schema)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with raw `logits`, summed over the rounds; zeros before the first."""
        return self._mapped(df, lambda m, x: m.logits(x), "logits")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with `proba`."""
        return self._mapped(df, lambda m, x: softmax_rows(m.logits(x)), "proba")

    def predict_all(self, df: DataFrame) -> DataFrame:
        """(id, label, round, class, logit) of each round alone; round 0 holds the logits of equal classes."""
        sent = df.sparkSession.sparkContext.broadcast(self.model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    z = sent.value.stages(features_matrix(b.column(1)))
                    r, i, k = (v.ravel() for v in np.indices(z.shape))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(2).take(pa.array(i)), pa.array(r.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(z.ravel())], ["id", "label", "round", "class", "logit"])

        return df.select("id", "features", F.col("label").cast("int").alias("label")).mapInArrow(run, "id long, label int, round int, class int, logit double")

    # model as tables

    def splits(self, spark) -> DataFrame:
        m = self.model
        rows = [(r, b, int(m.features[r, b]), float(m.midpoints[r, b])) for r in range(m.rounds) for b in range(m.bits)]
        return spark.createDataFrame(rows, "round int, bit int, feature int, midpoint double")

    def leaf_table(self, spark) -> DataFrame:
        """Visited buckets only."""
        m, leaves = self.model, self.model.leaves
        rows = [(int(r), int(c), int(k), float(m.g[r, c, k]), float(m.h[r, c, k]), float(leaves[r, c, k])) for r, c, k in zip(*np.nonzero(m.h), strict=True)]
        return spark.createDataFrame(rows, "round int, bucket int, class int, g double, h double, leaf double")

    @classmethod
    def from_tables(cls, splits: DataFrame, leaves: DataFrame, num_classes: int, lr: float = 0.1, max_hashes: int = 100, **kwargs) -> HashBoost:
        held = splits.collect()  # the model's size
        bits = 1 + max((r["bit"] for r in held), default=0)
        out = cls(num_classes, bits, lr, max_hashes, **kwargs)
        by = {(r["round"], r["bit"]): r for r in held}
        for r in range(1 + max((r["round"] for r in held), default=-1)):
            out.model.add([by[r, b]["feature"] for b in range(bits)], [by[r, b]["midpoint"] for b in range(bits)])
        for x in leaves.collect():
            out.model.g[x["round"], x["bucket"], x["class"]] = x["g"]
            out.model.h[x["round"], x["bucket"], x["class"]] = x["h"]
        return out


def learning_curve(booster: HashBoost, batches: Callable[[int], list[DataFrame]], splits: dict[str, DataFrame], epochs: int, progress: Callable[[str], None] | None = None) -> list[dict]:
    """Trains for some epochs; after each the error rate on each split: (split, epoch, batches, error_rate). progress is told of each batch and measure."""
    from strataloom.operators.metrics import error_rate, label_of

    out, count = [], 0
    for epoch in range(epochs):
        for batch in batches(epoch):
            booster.fit_batch(batch)
            count += 1
            if progress:
                progress(f"epoch {epoch}: {count} batches")
        for name, df in splits.items():
            err = error_rate(booster.predict_proba(df).withColumn("prediction", label_of(F.col("proba")))).first()
            out.append({"split": name, "epoch": epoch, "batches": count, "error_rate": err["error_rate"]})
            if progress:
                progress(f"epoch {epoch}: {name} error {err['error_rate']:.4f}")
    return out
