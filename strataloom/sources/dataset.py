"""Labelled series as a lazy table view: selection, shuffling, splitting and batching by id instead of by file position."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators.ordering import shuffle_key, with_position
from strataloom.sources.folders import remove, shared_folder


def read_npy(spark: SparkSession, path_x: str, path_y: str, rows_per_read: int = 65536) -> DataFrame:
    """(id, series, label) from a series and a label .npy file that all executors can open; each task maps its own rows."""
    x = np.load(path_x, mmap_mode="r")
    n, ndim = len(x), x.ndim
    channels = ndim == 3 and x.shape[1] > 1
    kind = "array<array<double>>" if channels else "array<double>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = np.load(path_x, mmap_mode="r"), np.load(path_y, mmap_mode="r")
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                hi = min(lo + rows_per_read, n)
                own = np.asarray(xs[lo:hi], dtype=float)
                own = own if channels else own.reshape(hi - lo, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(own.tolist()), pa.array(np.asarray(ys[lo:hi]).astype(np.int32))], ["id", "series", "label"])

    starts = spark.range(0, max(n, 1), rows_per_read, max(1, -(-n // rows_per_read)))
    return starts.where(F.col("id") < n).mapInArrow(rows, f"id long, series {kind}, label int")


def read_fold(spark: SparkSession, path: str) -> DataFrame:
    """Row ids (column id) of a white-space separated text file of numbers."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).where("word <> ''")
    return words.select(F.col("word").cast("double").cast("long").alias("id"))


class SeriesDataset:
    """A view (id, series, label) of a table. Views share the data and hold only their filter, batch size and shuffling."""

    def __init__(self, df: DataFrame, batch_size: int = 256, shuffle: bool = True, seed: int = 42):
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        self.df, self.batch_size, self.shuffle, self.seed = df, batch_size, shuffle, seed
        self.epoch = -1
        self._cached = False
        self._folders: list[str] = []

    @classmethod
    def from_table(cls, df: DataFrame, id_col: str, series_col: str, label_col: str, **kwargs) -> SeriesDataset:
        return cls(df.select(F.col(id_col).alias("id"), F.col(series_col).alias("series"), F.col(label_col).cast("int").alias("label")), **kwargs)

    @classmethod
    def from_npy(cls, spark: SparkSession, path_x: str, path_y: str, **kwargs) -> SeriesDataset:
        return cls(read_npy(spark, path_x, path_y), **kwargs)

    def view(self, df: DataFrame) -> SeriesDataset:
        return SeriesDataset(df, self.batch_size, self.shuffle, self.seed)

    def open(self) -> SeriesDataset:
        """Keeps the view's rows in memory and on disk; repeated calls change nothing."""
        if not self._cached:
            self.df.persist()
            self._cached = True
        return self

    def close(self) -> None:
        """Lets go of what open() kept and of written positions, for this view only."""
        while self._folders:
            remove(self.df.sparkSession, self._folders.pop())
        if self._cached:
            self.df.unpersist()
            self._cached = False

    def __getitem__(self, ids: DataFrame | list[int] | range) -> SeriesDataset:
        """The rows whose ids are given (a table with column id, or a short list); views of views compose."""
        if isinstance(ids, DataFrame):
            return self.view(self.df.join(ids.select("id").distinct(), "id", "left_semi"))
        return self.view(self.df.where(F.col("id").isin([int(i) for i in ids])))

    def without(self, ids: DataFrame) -> SeriesDataset:
        """All rows but those of a fold."""
        return self.view(self.df.join(ids.select("id").distinct(), "id", "left_anti"))

    @cached_property
    def classes(self) -> list[int]:
        return [r["label"] for r in self.df.select("label").distinct().orderBy("label").collect()]  # one row a class

    @cached_property
    def shape(self) -> tuple[int, ...]:
        series = self.df.schema["series"].dataType
        nested = series.elementType.typeName() == "array"
        inner = [F.max(F.size("series"))] + ([F.max(F.size(F.col("series")[0]))] if nested else [])
        n, *rest = self.df.agg(F.count("*"), *inner).first()
        return (n, *(int(x or 0) for x in rest))

    @property
    def labels(self) -> DataFrame:
        return self.df.select("id", "label")

    def positions(self, epoch: int = 0) -> DataFrame:
        """id and the 0-based position of each row in this epoch's order; only ids move."""
        ids = self.df.select("id")
        if self.shuffle:
            return with_position(ids, shuffle_key("id", self.seed, epoch), "id")
        # in order of ids: the ranges of a range partitioning, numbered as they are and written, so that counts and numbers agree
        spark, part = ids.sparkSession, F.shiftright("__at", 33)
        self._folders.append(shared_folder(spark, "positions"))
        ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("__at", F.monotonically_increasing_id()).write.parquet(self._folders[-1])
        ranked = spark.read.parquet(self._folders[-1])
        sizes = ranked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a partition
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = ranked.withColumn("__part", part).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
        return placed.select("id", (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("position"))

    def batches(self, epoch: int = 0) -> DataFrame:
        """The view with position and batch_id; the last batch may be short."""
        return self.df.join(self.positions(epoch), "id").withColumn("batch_id", F.floor(F.col("position") / self.batch_size).cast("int"))

    @property
    def num_batches(self) -> int:
        return -(-self.shape[0] // self.batch_size)

    def set_batch_size(self, limit_mb: float) -> None:
        """As many rows as fit the limit as float32."""
        _, *inner = self.shape
        self.batch_size = max(1, int(limit_mb * (1 << 20) // (4 * int(np.prod(inner)))))

    def __iter__(self) -> Iterator[DataFrame]:
        """The batches of the next epoch, each a DataFrame; every iteration is a new epoch with an order of its own.

        Rows are dealt out to folders by batch once an epoch, so that each batch reads its own rows only.
        """
        self.epoch += 1
        spark = self.df.sparkSession
        folder = shared_folder(spark, "batches")
        rows = self.batches(self.epoch)
        rows.repartition("batch_id").write.partitionBy("batch_id").parquet(folder)
        own = rows.drop("batch_id").schema
        try:
            for i in range(self.num_batches):
                yield spark.read.schema(own).parquet(f"{folder}/batch_id={i}").withColumn("batch_id", F.lit(i))
        finally:
            remove(spark, folder)

    def split(self, **sizes: int) -> dict[str, SeriesDataset]:
        """Disjoint views of consecutive stretches of the shuffled order, by name and size."""
        places, out, lo = with_position(self.df.select("id"), shuffle_key("id", self.seed), "id"), {}, 0
        for name, n in sizes.items():
            out[name] = self[places.where((F.col("position") >= lo) & (F.col("position") < lo + n))]
            lo += n
        return out

    def head(self, n: int) -> DataFrame:
        """The first n rows of the shuffled order."""
        return self.df.orderBy(shuffle_key("id", self.seed), "id").limit(n)

    def materialised(self) -> DataFrame:
        """All rows as float32 series, one after another, and int labels, kept."""
        return self.df.select("id", flattened("series", self.df).cast("array<float>").alias("series"), F.col("label").cast("int").alias("label")).persist()

    def flat(self) -> DataFrame:
        """Channels one after another as one feature array of doubles."""
        return self.df.select("id", flattened("series", self.df).cast("array<double>").alias("features"), "label")


def flattened(name: str, df: DataFrame) -> Column:
    nested = df.schema[name].dataType.elementType.typeName() == "array"
    return F.flatten(name) if nested else F.col(name)


def dense_labels(df: DataFrame, label_col: str = "label") -> tuple[DataFrame, list]:
    """df with labels 0..K-1 in sorted order of the old ones, and the old ones; classes are taken from all of df."""
    values = [r[0] for r in df.select(label_col).where(F.col(label_col).isNotNull()).distinct().orderBy(label_col).collect()]  # one row a class
    place = F.create_map(*(F.lit(x) for i, v in enumerate(values) for x in (v, i))) if values else None
    return df.withColumn(label_col, F.element_at(place, F.col(label_col)).cast("int") if values else F.lit(None).cast("int")), values


def estimator_quota(estimators: int, num_batches: int) -> list[int]:
    """Estimators of each batch: an equal share, at least one, the remainder to the first batches."""
    share = max(1, estimators // num_batches)
    rest = max(0, estimators - share * num_batches)
    return [share + (i < rest) for i in range(num_batches)]
