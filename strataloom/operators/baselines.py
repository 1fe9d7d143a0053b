"""Off-the-shelf learners to compare with, from Spark's own library.

Gradient boosting there is binary, so several classes are learned one against the rest, each stopped early by hand: rounds
after the least validation loss are left out once it hasn't fallen for `patience` rounds. Trees go to depth 30 at most.
What stands in for what is in `substitute` of each entry; overrides of run_baseline() aren't in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.boosting import argmax
from strataloom.operators.metrics import error_rate

Predict = Callable[[DataFrame], DataFrame]


@dataclass
class Baseline:
    name: str
    params: dict[str, Any]
    substitute: str

    def fit(self, train: DataFrame, valid: DataFrame) -> tuple[Predict, dict[str, Any]]:
        """What adds `prediction` to rows (features as a vector, label as a double), and facts about the fit."""
        p = self.params
        if self.name == "tree":
            return DecisionTreeClassifier(maxDepth=min(30, p["max_depth"]), seed=p["seed"], maxBins=32).fit(train).transform, {}
        if self.name == "forest":
            return RandomForestClassifier(numTrees=p["trees"], impurity="entropy", featureSubsetStrategy=str(p["max_features"]), bootstrap=False, maxDepth=p["max_depth"], seed=p["seed"]).fit(train).transform, {}
        return boosted(train, valid, p)


BOOSTED = {"learning_rate": 0.05, "max_depth": 5, "rounds": 1000, "patience": 50, "seed": 42}
BASELINES = [
    Baseline("boosted_depthwise", {**BOOSTED, "max_depth": 6}, "one-versus-rest binary boosting for multi-class softmax boosting"),
    Baseline("boosted_leafwise", BOOSTED, "depth 5 (at most 32 leaves) for leaf-wise growth to 31 leaves"),
    Baseline("boosted_ordered", {**BOOSTED, "max_depth": 6}, "plain boosting for ordered boosting"),
    Baseline("tree", {"max_depth": 32, "seed": 42}, "depth 30, the library's limit, for 32"),
    Baseline("forest", {"trees": 200, "max_features": 0.1, "max_depth": 30, "seed": 42}, "best splits over bins for random thresholds"),
]


def boosted(train: DataFrame, valid: DataFrame, p: dict[str, Any]) -> tuple[Predict, dict[str, Any]]:
    """One binary booster a class, each with the rounds that early stopping leaves; the largest margin wins, ties to the lowest class."""
    classes = [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]  # one row a class
    models, kept = [], []
    for c in classes:
        own, seen = (df.withColumn("label", (F.col("label") == c).cast("double")) for df in (train, valid))
        learner = GBTClassifier(maxIter=p["rounds"], maxDepth=p["max_depth"], stepSize=p["learning_rate"], seed=p["seed"])
        model = learner.fit(own)
        rounds = early_stopped(model.evaluateEachIteration(seen), p["patience"])
        if rounds < model.getNumTrees:
            model = learner.copy({learner.maxIter: rounds}).fit(own)  # the same first rounds: the seed is fixed
        models.append(model.setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol(""))
        kept.append(rounds)

    def predict(df: DataFrame) -> DataFrame:
        margins = []
        for k, model in enumerate(models):
            df = model.transform(df).withColumn(f"__m{k}", vector_to_array("__raw")[1]).drop("__raw")
            margins.append(f"__m{k}")
        best = F.element_at(F.array(*map(F.lit, classes)), argmax(F.array(*margins)) + 1)
        return df.withColumn("prediction", best).drop(*margins)

    return predict, {"rounds": kept}


def with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col("features").cast("array<double>"))).withColumn("label", F.col("label").cast("double"))


def run_baseline(baseline: Baseline, train: DataFrame, splits: dict[str, DataFrame], valid: str = "valid", **overrides: Any) -> dict[str, float]:
    """Error rate on each split; `valid` names the one that stops boosting (the training rows if there is none). Overrides change parameters, such as fewer rounds or trees."""
    learner = Baseline(baseline.name, {**baseline.params, **overrides}, baseline.substitute)
    predict, _ = learner.fit(with_vector(train), with_vector(splits.get(valid, train)))
    return {name: error_rate(predict(with_vector(df))).first()["error_rate"] for name, df in splits.items()}


def early_stopped(errors: list[float], patience: int = 50) -> int:
    """Number of rounds to keep: those up to the least error once it hasn't fallen for `patience` rounds."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1
