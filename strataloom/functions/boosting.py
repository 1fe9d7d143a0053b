"""Column expressions of the hash-partition booster: class vectors are arrays indexed by the dense label 0..K-1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.series import let

HESSIAN_FLOOR = 1e-3  # fixed values of the update rule
DENOMINATOR_FLOOR = 1e-6
PROBABILITY_FLOOR = 1.1920929e-07  # float32 machine epsilon, of the log-loss


def one_hot(label: Column, num_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda c: F.when(c == label, 1).otherwise(0))


def softmax(logits: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda v: v / total))

    return let(let(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp(x - m))), shares)


def cross_entropy(proba: Column, label: Column) -> Column:
    return -F.ln(F.element_at(proba, label.cast("int") + 1))


def clipped_log_loss(proba: Column, label: Column) -> Column:
    p = F.element_at(proba, label.cast("int") + 1)
    return -F.ln(F.least(F.greatest(p, F.lit(PROBABILITY_FLOOR)), F.lit(1.0 - PROBABILITY_FLOOR)))


def residuals(proba: Column, label: Column) -> Column:
    return F.transform(proba, lambda p, c: p - F.when(c == label, 1.0).otherwise(0.0))


def hessians(proba: Column) -> Column:
    return F.transform(proba, lambda p: p * (1.0 - p) + HESSIAN_FLOOR)


def bucket(features: Column, picked: list[int], midpoints: list[float]) -> Column:
    """Answers of the threshold tests as a number; the first test is the least significant bit; equal counts as below."""
    total = F.lit(0)
    for bit, (f, m) in enumerate(zip(picked, midpoints, strict=True)):
        total = total + F.when(features[f] <= F.lit(float(m)), F.lit(1 << bit)).otherwise(F.lit(0))
    return total


def argmax(values: Column) -> Column:
    """Index of the largest value; ties go to the lowest."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def uniform_logits(num_classes: int) -> list[float]:
    return [math.log(1.0 / num_classes)] * num_classes


def pick_feature(seed: int, round_: int, bit: int, num_features: int) -> int:
    """Portable choice of a feature, the same in any engine with 64-bit integers."""
    return ((seed + 8191 * round_ + 131 * bit + 1) * 2654435761 % 4294967296) * num_features // 4294967296
