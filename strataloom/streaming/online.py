"""The booster as an online learner over Structured Streaming micro-batches.

A batch changes the model only once: the state names the last batch that it holds, and batches up to it are skipped when a
restarted query sends them again. The state is one file in a folder that outlives the driver, next to the stream's own
checkpoint unless another place is given; it is written under a new name and renamed over the old one.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataloom.operators.hashboost import HashBoost
from strataloom.sources.folders import read_bytes, write_bytes


class OnlineTrainer:
    """state: a file on any of Spark's file systems, or None until start() puts it beside the checkpoint."""

    def __init__(self, booster: HashBoost, state: str | None = None):
        self.booster, self.state, self.last_batch, self._loaded = booster, state, -1, False

    def _load(self, spark: SparkSession) -> None:
        if self.state and not self._loaded:
            held = read_bytes(spark, self.state)
            if held is not None:
                self.last_batch, self.booster.model = pickle.loads(held)
        self._loaded = True

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. Batches seen before and batches without two classes change nothing."""
        spark = batch.sparkSession
        self._load(spark)
        if batch_id <= self.last_batch:
            return
        rows = batch.persist()
        try:
            if rows.agg(F.countDistinct("label")).first()[0] > 1:
                self.booster.fit_batch(rows)
        finally:
            rows.unpersist()
        self.last_batch = batch_id
        if self.state:
            write_bytes(spark, self.state, pickle.dumps((batch_id, self.booster.model)))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Trains on a stream of (id, features, label) until what is there has been read."""
        self.state = self.state or f"{checkpoint.rstrip('/')}-model.pickle"
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
