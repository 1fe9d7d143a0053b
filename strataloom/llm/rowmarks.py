"""Marks on rows of Parquet files, found again by file and row number: only marks move, at any size, never the rows.

A row is known by a hash of its file's path and its number there. Marks are written to the shared folder, sorted, in folders by
a hash of the file; a task that reads rows of a file looks up the marks of that file alone. So a wide table is filtered or
looked at in part without a shuffle and without sending a list to all tasks.

Defined cases: rows from anything but plain scans of Parquet files are written to the shared folder first; rows without a mark
have none (null); no marks at all leave every row without; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import file_system, fresh_dir, saved

PLACE = ["__file", "__row"]
MARKS = 100_000  # marks in a folder, about
_PLAIN = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def _is_scan(docs: DataFrame) -> bool:
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in _PLAIN:
        if not node.children().size():
            return "parquet" in docs._jdf.queryExecution().executedPlan().toString().lower()
        node = node.children().head()
    return False


def located(docs: DataFrame) -> DataFrame:
    """docs with __file and __row, longs."""
    if not _is_scan(docs):
        docs = saved(docs, "rows")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


class _Marks:
    """The marks of one file at a time."""

    def __init__(self, folder: str, folders: int):
        self.files, self.root = file_system(folder)
        self.folders, self.file = folders, None

    def of(self, file: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have a mark, and the marks of those."""
        import pyarrow.dataset as ds
        from pyarrow.fs import FileType

        if file != self.file:
            at = f"{self.root}/folder={file % self.folders}"
            self.file, self.rows, self.marks = file, np.zeros(0, np.int64), np.zeros(0, np.int64)
            if self.files.get_file_info(at).type == FileType.Directory:
                own = ds.dataset(at, filesystem=self.files, format="parquet").to_table(filter=pc.field("file") == file).sort_by("row")
                self.rows, self.marks = own.column("row").to_numpy(), own.column("mark").to_numpy()
        if not len(self.rows):
            return np.zeros(len(rows), bool), self.marks
        place = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
        found = self.rows[place] == rows
        return found, self.marks[place[found]]


def with_marks(rows: DataFrame, marks: DataFrame, fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """fn(batch of rows without their place, which have a mark, marks of those), batch by batch.

    rows: columns and PLACE at the end, from located(). marks: file, row, mark, all longs, at most one for a row.
    """
    folder = fresh_dir(rows.sparkSession, "marks")
    marks = saved(marks, "mark-rows")
    folders = max(1, math.ceil(marks.count() / MARKS))
    own = marks.withColumn("folder", F.pmod("file", F.lit(folders)))
    own.repartition(min(folders, 10_000), "folder").sortWithinPartitions("folder", "file", "row").write.partitionBy("folder").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Marks(folder, folders)
        for batch in batches:
            n = batch.num_columns - 2
            file, row = batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            cut = np.flatnonzero(np.r_[True, file[1:] != file[:-1]]) if len(file) else []
            for lo, hi in zip(cut, [*cut[1:], len(file)], strict=True):
                found, values = known.of(int(file[lo]), row[lo:hi])
                yield fn(batch.slice(lo, hi - lo).select(list(range(n))), found, values)

    return rows.mapInArrow(run, schema)


def without(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (from located()) without those that have a mark (file, row), and without their place."""
    kept = rows.drop(*PLACE)
    return with_marks(rows, marks.select("file", "row", F.lit(0).cast("long").alias("mark")), lambda batch, found, _: batch.filter(pa.array(~found)), kept.schema)
