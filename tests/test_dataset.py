import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import metrics
from strataloom.operators.baselines import BASELINES, boosted, early_stopped, run_baseline, with_vector
from strataloom.operators.forest import QuantForest, grow
from strataloom.operators.ordering import shuffle_key, with_position
from strataloom.sources.dataset import SeriesDataset, dense_labels, read_fold, read_npy
from strataloom.sources.results import Stopwatch, curve, git_hash, plot_curves, results_document, write_results


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (np.sin(np.arange(16) * (1 + i % 2)) + rng.normal(size=16) * 0.1).tolist(), i % 2) for i in range(50)]
    return SeriesDataset(spark.createDataFrame(rows, "id long, series array<double>, label int"), batch_size=8)


def test_views(spark, data):
    odd = data[data.df.where("id % 2 = 1").select("id")]
    assert odd.shape == (25, 16) and odd.classes == [1] and odd.batch_size == 8
    assert odd[[1, 3, 4]].shape[0] == 2
    assert data.without(odd.df).shape[0] == 25
    assert data.labels.columns == ["id", "label"]
    assert data.open().open() is data
    data.close()
    data.close()


def test_batches_cover_each_epoch_once(data):
    rows = data.batches(0).collect()
    sizes = np.bincount([r["batch_id"] for r in rows])
    assert sizes.tolist() == [8] * 6 + [2] and data.num_batches == 7
    order = lambda rows: [r["id"] for r in sorted(rows, key=lambda r: r["position"])]
    assert order(rows) != order(data.batches(1).collect()) and order(rows) == order(data.batches(0).collect())
    seen = [r["id"] for b in data for r in b.collect()]
    assert sorted(seen) == list(range(50))
    plain = SeriesDataset(data.df, 8, shuffle=False)
    assert all(r["position"] == r["id"] for r in plain.positions().collect())


def test_split_is_disjoint_and_sized(data):
    parts = data.split(train=30, valid=10, test=10)
    ids = {k: {r["id"] for r in v.df.collect()} for k, v in parts.items()}
    assert [len(v) for v in ids.values()] == [30, 10, 10] and len(set.union(*ids.values())) == 50
    assert {r["id"] for r in data.head(30).collect()} == ids["train"]


def test_memory_batches_and_flat(data):
    view = data.view(data.df)
    view.set_batch_size(16 * 4 * 5 / (1 << 20))
    assert view.batch_size == 5
    assert len(data.flat().first()["features"]) == 16
    assert data.materialised().schema["series"].dataType.elementType.typeName() == "float"
    with pytest.raises(ValueError):
        SeriesDataset(data.df, 0)


def test_files(spark, tmp_path):
    x, y = np.arange(24, dtype=np.float32).reshape(4, 1, 6), np.array([0, 1, 0, 1])
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", y)
    rows = read_npy(spark, str(tmp_path / "x.npy"), str(tmp_path / "y.npy"), rows_per_read=3).orderBy("id").collect()
    assert [r["label"] for r in rows] == [0, 1, 0, 1] and rows[2]["series"] == x[2, 0].tolist()
    (tmp_path / "fold.txt").write_text("1.0 3\n2e0\n\n")
    assert sorted(r["id"] for r in read_fold(spark, str(tmp_path / "fold.txt")).collect()) == [1, 2, 3]


def test_dense_labels(spark):
    rows, values = dense_labels(spark.createDataFrame([("b",), ("a",), (None,), ("d",)], "label string"))
    assert values == ["a", "b", "d"] and [r["label"] for r in rows.collect()] == [1, 0, None, 2]


def test_empty_dataset(spark, data):
    empty = data.view(data.df.where("false"))
    assert empty.shape[0] == 0 and empty.classes == [] and empty.num_batches == 0


def test_forest_learns(data):
    forest = QuantForest(num_estimators=6, limit_mb=16 * 4 * 25 / (1 << 20), depth=2).fit(data.view(data.df))
    assert len(forest.trees) == 6
    error, loss = forest.score_log_loss(data)
    assert error < 0.1 and 0 <= loss < 0.5 and forest.error_rate(data) == error
    with pytest.raises(ValueError):
        QuantForest().predict_proba(data.df)


def test_tree_fits_its_rows():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 4)), rng.integers(0, 3, 60)
    tree = grow(x, y, 3, 0.5, rng)
    assert (tree.predict(x).argmax(1) == y).all()


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (1, 1)], "prediction int, label int")
    assert metrics.error_rate(df).first()["error_rate"] == 0.25
    assert {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(df).collect()} == {(0, 0): 1, (0, 1): 1, (1, 1): 2}
    assert metrics.class_count(df).first()[0] == 2
    points = spark.createDataFrame([(2, 0.5), (1, 0.5), (3, 0.7)], "x int, y double")
    assert tuple(metrics.best_and_last(points, "x", "y").first()) == (0.5, 1, 0.7)
    assert metrics.normalised_measure("Accuracy", 0.9) == ("merror", pytest.approx(0.1)) and metrics.normalised_measure("multi_error", 0.2) == ("merror", 0.2)
    assert tuple(curve(points, "x", "y").first()["curve"]) == ([1, 2, 3], [0.5, 0.5, 0.7])


def test_results_document(spark, tmp_path):
    watch = Stopwatch()
    with watch("tree"), watch("inner"):
        pass
    with pytest.raises(KeyError), watch("tree"):
        raise KeyError
    assert [r[0] for r in watch.rows] == ["inner", "tree", "tree"]
    points = spark.createDataFrame([("tree", "depth", s, "merror", x, x / 8) for s in ("train", "valid") for x in (2, 1)], "model string, x_name string, split string, metric string, x int, y double")
    curves = curve(points, "x", "y", "model", "x_name", "split", "metric")
    params = spark.createDataFrame([("tree", 3)], "model string, depth int").select("model", F.struct("depth").alias("params"))
    path = write_results(results_document(curves, params, watch.table(spark), dataset="series", length=16), f"{tmp_path}/deep/run")
    document = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
    tree = document["models"]["tree"]
    assert tree["params"]["depth"] == 3 and len(tree["timings"]) == 2 and document["dataset"] == "series" and document["length"] == 16 and tree["x_name"] == "depth"
    assert tree["results"]["valid"]["merror"] == {"x": [1, 2], "y": [0.125, 0.25]}
    assert git_hash() is None or isinstance(git_hash(), str)
    plot_curves(spark.createDataFrame([(1, 0.5, "a")], "x int, y double, s string"), "x", "y", "s", tmp_path / "p.png")


@pytest.mark.parametrize("step", [1, 10, 1 << 31, (1 << 32) + 1])
def test_keys_are_even_whatever_the_ids(spark, step):
    ids = spark.range(8000).select((F.col("id") * step).alias("id"))
    counts = ids.groupBy(F.floor(shuffle_key("id", 7) / (1 << 28)).alias("b")).count().collect()
    assert len(counts) == 16 and max(r["count"] for r in counts) < 650
    placed = with_position(ids, shuffle_key("id", 7), "id").collect()
    assert sorted(r["position"] for r in placed) == list(range(8000))


def test_baselines(data):
    rows = data.flat()
    found = run_baseline(next(b for b in BASELINES if b.name == "tree"), rows, {"train": rows})
    assert found["train"] < 0.1
    assert early_stopped([0.5, 0.4, 0.45, 0.46, 0.3], patience=2) == 2 and early_stopped([0.5, 0.4], 50) == 2


def test_boosting_stops_early(data):
    rows = with_vector(data.flat())
    noise = rows.withColumn("label", F.pmod(F.xxhash64("id"), F.lit(2)).cast("double"))  # nothing to learn for these
    predict, facts = boosted(rows, noise, {"rounds": 4, "max_depth": 2, "learning_rate": 0.3, "patience": 1, "seed": 1})
    assert len(facts["rounds"]) == 2 and all(1 <= r < 4 for r in facts["rounds"])
    assert metrics.error_rate(predict(rows)).first()["error_rate"] < 0.1
