"""A forest of extremely randomised trees, each batch growing its own share of them; batches are grown in parallel."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.hashboost import features_matrix
from strataloom.operators.metrics import error_rate, label_of, log_loss
from strataloom.operators.quant import Quant
from strataloom.sources.dataset import SeriesDataset, estimator_quota


@dataclass
class Tree:
    """Node i tests feature[i] <= threshold[i] and goes to left[i] or right[i]; feature -1: a leaf with class shares."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.shares[at]


def entropy(counts: np.ndarray) -> np.ndarray:
    """Of class counts along the last axis."""
    p = counts / np.maximum(counts.sum(-1, keepdims=True), 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def grow(x: np.ndarray, y: np.ndarray, num_classes: int, max_features: float, rng: np.random.Generator) -> Tree:
    """One tree on all rows: at each node a random threshold for each of some random features, the best by entropy, until pure."""
    nodes: list[list] = []
    todo = [(np.arange(len(y)), -1, False)]
    tries = max(1, int(max_features * x.shape[1]))
    indicators = np.eye(num_classes)[y]
    while todo:
        rows, parent, right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 if right else 2] = me
        counts = np.bincount(y[rows], minlength=num_classes)
        node = [-1, 0.0, -1, -1, counts / counts.sum()]
        nodes.append(node)
        if (counts > 0).sum() < 2:
            continue
        own = x[rows]
        low, high = own.min(0), own.max(0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            continue
        some = rng.permutation(usable)[:tries]
        cuts = low[some] + rng.random(len(some)) * (high[some] - low[some])
        below = own[:, some] <= cuts
        left = below.T.astype(float) @ indicators[rows]
        rest = counts - left
        n = len(rows)
        score = (left.sum(1) * entropy(left) + rest.sum(1) * entropy(rest)) / n
        score[(left.sum(1) == 0) | (rest.sum(1) == 0)] = np.inf
        best = int(score.argmin())
        if not np.isfinite(score[best]):
            continue
        node[0], node[1] = int(some[best]), float(cuts[best])
        todo += [(rows[~below[:, best]], me, True), (rows[below[:, best]], me, False)]
    return Tree(*(np.array([n[k] for n in nodes]) for k in range(5)))


class QuantForest:
    """Quantile features and a forest. fit() takes a SeriesDataset: batch size by limit_mb, estimators by batch quota."""

    def __init__(self, num_estimators: int = 200, max_features: float = 0.1, limit_mb: float = 100, seed: int = 0, depth: int = 6, div: int = 4, verbose: bool = False):
        self.num_estimators, self.max_features, self.limit_mb, self.seed, self.verbose = num_estimators, max_features, limit_mb, seed, verbose
        self.quant = Quant(depth=depth, div=div)
        self.trees: list[Tree] = []
        self.num_classes = 0

    @classmethod
    def from_trees(cls, trees: list[Tree], num_classes: int, **kwargs) -> QuantForest:
        """A forest of given trees over the features."""
        out = cls(num_estimators=len(trees), **kwargs)
        out.trees, out.num_classes = trees, num_classes
        return out

    def fit(self, data: SeriesDataset) -> QuantForest:
        """Trees of all batches together. A tree's rows are one batch: at most limit_mb of series in one task."""
        data.set_batch_size(self.limit_mb)
        self.num_classes = 1 + max(data.classes)  # of the whole table, whatever a batch holds
        quota = estimator_quota(self.num_estimators, data.num_batches)
        share, max_features, seed, k = dict(enumerate(quota)), self.max_features, self.seed, self.num_classes

        def train(key, rows: pd.DataFrame) -> pd.DataFrame:
            batch = int(key[0])
            rows = rows.sort_values("id")
            x, y = np.array(rows["features"].tolist()), rows["label"].to_numpy()
            made = [grow(x, y, k, max_features, np.random.default_rng([seed, batch, t])) for t in range(share[batch])]
            return pd.DataFrame({"batch_id": batch, "tree": range(len(made)), "body": [pickle.dumps(t) for t in made]})

        rows = self.quant.transform(data.batches()).select("batch_id", "id", "features", "label")
        grown = rows.groupBy("batch_id").applyInPandas(train, "batch_id int, tree int, body binary")
        self.trees = [pickle.loads(r["body"]) for r in grown.orderBy("batch_id", "tree").collect()]  # the model
        if self.verbose:
            print(f"{len(self.trees)} trees from {data.num_batches} batches")
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(id, label, proba): mean class shares of all trees."""
        if not self.trees:
            raise ValueError("fit first")
        sent = df.sparkSession.sparkContext.broadcast(self.trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = features_matrix(b.column(1))
                    p = sum(t.predict(x) for t in sent.value) / len(sent.value)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(p), pa.list_(pa.float64()))], ["id", "label", "proba"])

        rows = self.quant.transform(df).select("id", "features", F.col("label").cast("int").alias("label"))
        return rows.mapInArrow(run, "id long, label int, proba array<double>")

    def error_rate(self, data: SeriesDataset) -> float:
        return error_rate(self.predict_proba(data.df).withColumn("prediction", label_of(F.col("proba")))).first()["error_rate"]

    def score_log_loss(self, data: SeriesDataset) -> tuple[float, float]:
        """Error rate and mean negative log-likelihood of clipped probabilities."""
        rows = self.predict_proba(data.df).withColumn("prediction", label_of(F.col("proba"))).persist()
        try:
            return error_rate(rows).first()["error_rate"], log_loss(rows).first()["log_loss"]
        finally:
            rows.unpersist()
