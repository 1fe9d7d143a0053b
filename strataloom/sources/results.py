"""Run results: curves, timings and one nested JSON document a run."""

from __future__ import annotations

import resource
import subprocess
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def git_hash(short: bool = True) -> str | None:
    """Of the working directory's commit; None where there is none."""
    try:
        return subprocess.run(["git", "rev-parse", *(["--short"] if short else []), "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def curve(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """A struct {x: [...], y: [...]} for each group, in the order of x."""
    points = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    return df.groupBy(*by).agg(points.alias("__p")).select(*by, F.struct(F.transform("__p", lambda p: p["x"]).alias("x"), F.transform("__p", lambda p: p["y"]).alias("y")).alias("curve"))


class Stopwatch:
    """Times blocks: `with watch("name"): ...`. rows holds (name, wall_s, cpu_s) of each block that ended, failed ones too."""

    def __init__(self):
        self.rows: list[tuple[str, float, float]] = []
        self._open: list[tuple[str, float, float]] = []

    @staticmethod
    def _now() -> tuple[float, float]:
        used = resource.getrusage(resource.RUSAGE_SELF)
        return time.monotonic(), used.ru_utime + used.ru_stime

    def __call__(self, name: str) -> Stopwatch:
        self._open.append((name, *self._now()))
        return self

    def __enter__(self) -> Stopwatch:
        return self

    def __exit__(self, *_) -> None:
        name, wall, cpu = self._open.pop()
        now = self._now()
        self.rows.append((name, now[0] - wall, now[1] - cpu))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "model string, wall_s double, cpu_s double")


def results_document(curves: DataFrame, params: DataFrame, timings: DataFrame | None = None, **info: Column | str | int | float) -> DataFrame:
    """One row, `document`: the JSON text of a run, made by the engine from typed tables.

    curves: model, x_name, split, metric and curve (of curve()). params: model and params, any struct or map. timings: of
    Stopwatch.table(). info: further fields at the top, next to the commit.
    """
    by_split = curves.groupBy("model", "x_name", "split").agg(F.map_from_entries(F.collect_list(F.struct("metric", "curve"))).alias("own"))
    models = by_split.groupBy("model", "x_name").agg(F.map_from_entries(F.collect_list(F.struct("split", "own"))).alias("results"))
    models = models.join(params.select("model", "params"), "model", "left")
    parts = [F.col("x_name"), F.col("params"), F.col("results")]
    if timings is not None:
        spent = timings.groupBy("model").agg(F.collect_list(F.struct("wall_s", "cpu_s")).alias("timings"))
        models, parts = models.join(spent, "model", "left"), [*parts, F.col("timings")]
    top = [F.lit(git_hash()).alias("commit"), *((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in info.items())]
    whole = models.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(*parts)))).alias("models"))
    return whole.select(F.to_json(F.struct(*top, "models"), {"pretty": "true"}).alias("document"))


def write_results(document: DataFrame, path: str) -> str:
    """Writes a document of results_document() as a folder of one text file; what is there is replaced."""
    document.coalesce(1).write.mode("overwrite").text(path)
    return path


def plot_curves(df: DataFrame, x: str, y: str, series: str, path: str | Path, title: str = "") -> Path | None:
    """Saves curves as a picture where matplotlib is installed; None elsewhere."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return None
    figure, axes = plt.subplots()
    for name, own in df.select(series, x, y).toPandas().sort_values(x).groupby(series):
        axes.plot(own[x], own[y], label=str(name))
    axes.set(title=title, xlabel=x, ylabel=y)
    axes.legend()
    figure.savefig(path)
    plt.close(figure)
    return Path(path)
