"""Representations of a series and quantiles of its intervals, as column expressions and as NumPy over Arrow batches.

A value that is null or NaN makes every feature null whose interval holds it. Computation is in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.intervals import make_intervals, quantile_count


def as_double(series: Column) -> Column:
    return F.transform(series, lambda x: x.cast("double"))


def doubles(values: Iterable[float]) -> str:
    """An array literal in SQL: one expression instead of one call for each number."""
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def diff(x: Column) -> Column:
    return F.zip_with(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.size(x) - 1), lambda b, a: b - a)


def identity(x: Column, length: int) -> Column:
    return as_double(x)


def smoothed_diff(x: Column, length: int) -> Column:
    """First difference, its ends repeated twice, averaged over five values."""

    def smooth(d: Column) -> Column:
        padded = F.concat(F.array_repeat(d[0], 2), d, F.array_repeat(d[length - 2], 2))
        return let(padded, lambda p: F.transform(F.sequence(F.lit(0), F.lit(length - 2)), lambda i: (p[i] + p[i + 1] + p[i + 2] + p[i + 3] + p[i + 4]) / 5.0))

    return let(diff(as_double(x)), smooth)


def second_diff(x: Column, length: int) -> Column:
    return let(diff(as_double(x)), diff)


def spectrum(x: Column, length: int) -> Column:
    """Magnitudes of the real discrete Fourier transform."""

    turns = [[2 * math.pi * ((k * i) % length) / length for i in range(length)] for k in range(length // 2 + 1)]
    waves = F.expr("array(" + ", ".join(f"struct({doubles(math.cos(t) for t in own)} as re, {doubles(math.sin(t) for t in own)} as im)" for own in turns) + ")")

    def part(v: Column, wave: Column) -> Column:
        return F.aggregate(F.zip_with(v, wave, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)

    def magnitudes(v: Column) -> Column:
        return F.transform(waves, lambda w: F.sqrt(F.pow(part(v, w["re"]), F.lit(2.0)) + F.pow(part(v, w["im"]), F.lit(2.0))))

    return let(as_double(x), magnitudes)


#: Name -> expression of (series, length), in the order of the feature vector; more can be registered.
REPRESENTATIONS: dict[str, Callable[[Column, int], Column]] = {"identity": identity, "smoothed_diff": smoothed_diff, "second_diff": second_diff, "spectrum": spectrum}


def interval_quantiles(x: Column, length: int, depth: int = 6, div: int = 4) -> Column:
    """Array of one array of features for each interval of make_intervals."""
    pieces = [(a, b - a, quantile_count(b - a, div)) for a, b in make_intervals(length, depth)]
    table = F.expr("array(" + ", ".join(f"struct({a} as a, {m} as m, {k} as k)" for a, m, k in pieces) + ")")

    def features(piece: Column) -> Column:
        own = F.slice(x, piece["a"] + 1, piece["m"])

        def quantiles(s: Column) -> Column:
            at = lambda j: F.when(piece["k"] == 1, (piece["m"] - 1) / F.lit(2.0)).otherwise((piece["m"] - 1) * j / F.greatest(piece["k"] - 1, F.lit(1)).cast("double"))
            mean = F.aggregate(own, F.lit(0.0), lambda t, v: t + v) / piece["m"]

            def value(j: Column) -> Column:
                place = at(j)
                low = F.floor(place).cast("int")
                lower, upper = s[low], s[F.least(low + 1, piece["m"] - 1)]
                return lower + (place - low) * (upper - lower) - F.when((piece["k"] > 1) & (j % 2 == 1), mean).otherwise(0.0)

            return F.transform(F.sequence(F.lit(0), piece["k"] - 1), value)

        bad = F.exists(own, lambda v: v.isNull() | F.isnan(v))
        return F.when(bad, F.transform(F.sequence(F.lit(0), piece["k"] - 1), lambda j: F.lit(None).cast("double"))).otherwise(let(F.sort_array(own), quantiles))

    return F.transform(table, features)


def numpy_representations(x: np.ndarray) -> dict[str, np.ndarray]:
    """The same representations of rows of x."""
    d = np.diff(x, axis=1)
    padded = np.pad(d, ((0, 0), (2, 2)), mode="edge")
    n = d.shape[1]
    return {"identity": x, "smoothed_diff": sum(padded[:, i : i + n] for i in range(5)) / 5.0, "second_diff": np.diff(d, axis=1), "spectrum": np.abs(np.fft.rfft(x, axis=1))}


def numpy_quantiles(z: np.ndarray, depth: int = 6, div: int = 4) -> np.ndarray:
    """Features of all intervals, side by side; NaN where an interval holds NaN."""
    out = []
    for a, b in make_intervals(z.shape[1], depth):
        own, k = z[:, a:b], quantile_count(b - a, div)
        ranked = np.sort(own, axis=1)
        place = np.array([(b - a - 1) / 2]) if k == 1 else (b - a - 1) * np.arange(k) / (k - 1)
        low = np.floor(place).astype(int)
        part = ranked[:, low] + (place - low) * (ranked[:, np.minimum(low + 1, b - a - 1)] - ranked[:, low])
        if k > 1:
            part[:, 1::2] -= own.mean(1, keepdims=True)
        part[np.isnan(own).any(1)] = np.nan
        out.append(part)
    return np.concatenate(out, axis=1)
