"""Quantile features of dyadic intervals over several representations of a series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.intervals import feature_count, representation_lengths
from strataloom.functions.series import REPRESENTATIONS, interval_quantiles, let, numpy_quantiles, numpy_representations

ARROW_LENGTH = 32  # series of this length and more go through NumPy by default, which is several times as fast there


class IntervalModel:
    """Quantile features of one representation of a known length. Nothing is learned."""

    def __init__(self, length: int, depth: int = 6, div: int = 4):
        if depth < 1 or div < 1:
            raise ValueError(f"depth and div must be at least 1, not {depth} and {div}")
        self.length, self.depth, self.div = length, depth, div

    def fit(self, df: DataFrame | None = None) -> IntervalModel:
        return self

    def transform(self, x: Column) -> Column:
        return F.flatten(interval_quantiles(x, self.length, self.depth, self.div))

    fit_transform = transform

    @property
    def num_features(self) -> int:
        return feature_count(self.length, self.depth, self.div)


class Quant(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds an array of doubles: interval quantiles of the identity, smoothed and second differences and the spectrum.

    Series of several channels give, interval by interval, the features of each channel in turn. method: "native"
    (column expressions), "arrow" (NumPy over Arrow batches) or "auto" (by length). Either is a map without a shuffle.
    """

    inputCol = Param(Params._dummy(), "inputCol", "column of the series", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the features", TypeConverters.toString)
    depth = Param(Params._dummy(), "depth", "levels of intervals", TypeConverters.toInt)
    div = Param(Params._dummy(), "div", "values for each quantile of an interval", TypeConverters.toInt)
    length = Param(Params._dummy(), "length", "length of the series; 0: that of the first row", TypeConverters.toInt)
    method = Param(Params._dummy(), "method", "native, arrow or auto", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "series", outputCol: str = "features", depth: int = 6, div: int = 4, length: int = 0, method: str = "auto"):
        super().__init__()
        self._setDefault(inputCol="series", outputCol="features", depth=6, div=4, length=0, method="auto")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        if self.getOrDefault("depth") < 1 or self.getOrDefault("div") < 1:
            raise ValueError("depth and div must be at least 1")
        if self.getOrDefault("method") not in ("native", "arrow", "auto"):
            raise ValueError("method must be native, arrow or auto")

    def num_features(self, length: int) -> int:
        return sum(feature_count(n, self.getOrDefault("depth"), self.getOrDefault("div")) for n in representation_lengths(length).values())

    def _shape(self, df: DataFrame) -> tuple[int, bool]:
        name = self.getOrDefault("inputCol")
        nested = df.schema[name].dataType.elementType.typeName() == "array"
        if (length := self.getOrDefault("length")) < 1:
            first = df.select(name).where(F.col(name).isNotNull()).first()
            if first is None:
                raise ValueError("no series to take the length from; set length")
            length = len(first[0][0]) if nested else len(first[0])
        representation_lengths(length)  # checks it
        return length, nested

    def _transform(self, df: DataFrame) -> DataFrame:
        length, nested = self._shape(df)
        method = self.getOrDefault("method")
        if method == "arrow" or method == "auto" and (nested or length >= ARROW_LENGTH):
            return self._arrow(df, length, nested)
        return self._native(df, length, nested)

    def _native(self, df: DataFrame, length: int, nested: bool) -> DataFrame:
        depth, div, name = self.getOrDefault("depth"), self.getOrDefault("div"), self.getOrDefault("inputCol")
        parts = []
        for kind, n in representation_lengths(length).items():
            pieces = pieces_of(kind, length, n, depth, div)
            parts.append(let(F.transform(name, pieces), by_interval) if nested else F.flatten(pieces(F.col(name))))
        same = F.size(F.col(name)[0] if nested else F.col(name)) == length
        checked = F.when(same, F.concat(*parts)).when(F.col(name).isNotNull(), F.raise_error(F.lit(f"a series isn't {length} long")).cast("array<double>"))
        return df.withColumn(self.getOrDefault("outputCol"), checked)

    def _arrow(self, df: DataFrame, length: int, nested: bool) -> DataFrame:
        depth, div, name, out = (self.getOrDefault(k) for k in ("depth", "div", "inputCol", "outputCol"))
        at = df.columns.index(name)
        kept = [i for i, c in enumerate(df.columns) if c != out]
        names = [*(df.columns[i] for i in kept), out]
        schema = ", ".join(f"`{df.schema[i].name}` {df.schema[i].dataType.simpleString()}" for i in kept) + f", `{out}` array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(at)
                flat = None if nested or column.null_count else column.flatten()
                if flat is not None and not flat.null_count and len(flat) == length * len(column) and (np.diff(column.offsets) == length).all():
                    x = flat.to_numpy().astype(float).reshape(len(column), 1, length)
                    made = np.concatenate([quantile_blocks(x, kind, depth, div) for kind in representation_lengths(length)], axis=1)
                    if not np.isnan(made).any():
                        ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], names)
                        continue
                rows = column.to_pylist()
                there = [i for i, r in enumerate(rows) if r is not None]
                x = np.array([rows[i] for i in there], dtype=float)
                features = [None] * len(rows)
                if there:
                    if x.shape[-1] != length:
                        raise ValueError(f"a series isn't {length} long")
                    channels = x if x.ndim == 3 else x[:, None, :]
                    made = [quantile_blocks(channels, kind, depth, div) for kind in representation_lengths(length)]
                    for i, row in zip(there, np.concatenate(made, axis=1), strict=True):
                        features[i] = [None if np.isnan(v) else v for v in row.tolist()] if np.isnan(row).any() else row
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(features, pa.list_(pa.float64()))], names)

        return df.mapInArrow(run, schema)


def pieces_of(kind: str, length: int, n: int, depth: int, div: int) -> Callable[[Column], Column]:
    """Series -> features of each interval of one representation."""
    return lambda x: let(REPRESENTATIONS[kind](x, length), lambda z: interval_quantiles(z, n, depth, div))


def by_interval(channels: Column) -> Column:
    """Features of each channel's intervals -> one array, interval by interval, in each the channels in turn."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(channels[0]) - 1), lambda i: F.flatten(F.transform(channels, lambda own: own[i]))))


def quantile_blocks(channels: np.ndarray, kind: str, depth: int, div: int) -> np.ndarray:
    """[rows, channels, values] -> features, channels side by side inside each interval."""
    from strataloom.functions.intervals import make_intervals, quantile_count

    parts = [numpy_quantiles(numpy_representations(channels[:, c])[kind], depth, div) for c in range(channels.shape[1])]
    if len(parts) == 1:
        return parts[0]
    n = representation_lengths(channels.shape[2])[kind]
    cuts = np.cumsum([0, *(quantile_count(b - a, div) for a, b in make_intervals(n, depth))])
    return np.concatenate([p[:, lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False) for p in parts], axis=1)
