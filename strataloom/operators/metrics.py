"""Error rates, log-loss, staged errors and learning curves as DataFrame aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.boosting import argmax, clipped_log_loss

#: Names that outside learners use for their measures -> (our name, whether it is an accuracy).
MEASURES = {"multi_error": ("merror", False), "merror": ("merror", False), "Accuracy": ("merror", True), "accuracy": ("merror", True)}


def label_of(values: Column) -> Column:
    """The class of the largest logit or probability, to nine places, so that ties go to the lowest class whatever the order of additions."""
    return argmax(F.transform(values, lambda x: F.round(x, 9)))


def class_count(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.countDistinct(label).alias("num_classes"))


def error_rate(df: DataFrame, prediction: str = "prediction", label: str = "label", *by: str) -> DataFrame:
    """Share of rows (not of batches) whose prediction isn't the label."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(prediction) != F.col(label)).cast("double")).alias("error_rate"))


def log_loss(df: DataFrame, proba: str = "proba", label: str = "label", *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(clipped_log_loss(F.col(proba), F.col(label))).alias("log_loss"))


def confusion_matrix(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def staged_predictions(stages: DataFrame) -> DataFrame:
    """(id, label, round, prediction) from logits (id, label, round, class, logit) of every round: running sums to nine places, ties to the lowest class."""
    running = F.sum("logit").over(Window.partitionBy("id", "class").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = stages.withColumn("total", F.round(running, 9))
    best = F.max_by(F.col("class"), F.struct("total", -F.col("class")))
    return sums.groupBy("id", "round").agg(F.first("label").alias("label"), best.alias("prediction"))


def staged_error(stages: DataFrame) -> DataFrame:
    """(round, n, error_rate) of the model cut off after each round."""
    return error_rate(staged_predictions(stages), "prediction", "label", "round")


def best_and_last(curve: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Least value with where it is (ties: the first), and the value at the end."""
    return curve.groupBy(*by).agg(F.min(y).alias("best"), F.min_by(x, F.struct(y, x)).alias("best_at"), F.max_by(y, x).alias("last"))


def normalised_measure(name: str, value: float) -> tuple[str, float]:
    """A measure under our name, accuracies turned into error rates."""
    ours, accuracy = MEASURES.get(name, (name, False))
    return ours, 1.0 - value if accuracy else value
