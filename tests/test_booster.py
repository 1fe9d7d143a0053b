import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions.boosting import argmax, bucket, clipped_log_loss, cross_entropy, softmax
from strataloom.operators import metrics
from strataloom.operators.hashboost import HashBoost, learning_curve, pair_up
from strataloom.sources.dataset import estimator_quota
from strataloom.streaming.online import OnlineTrainer

ROWS = [(0, [0.0, 5.0], 0), (1, [1.0, 6.0], 0), (2, [2.0, 1.0], 1), (3, [3.0, 0.0], 1)]


@pytest.mark.parametrize("labels,n,pairs", [([0, 0, 0, 1, 2, 0, 1], 2, [(0, 3), (1, 4)]), ([0, 0, 0, 1, 2, 0, 1], 3, [(0, 3), (1, 4), (2, 6)]), ([0, 1], 3, [(0, 1)] * 3), ([0, 0, 0, 0, 1], 2, [(0, 4), (1, 4)])])
def test_pairs_by_hand(labels, n, pairs):
    assert pair_up(labels, n)[0] == pairs


def slot_scan(labels, n):
    """Fill n slots in turn; each keeps its first position and takes the next of another class."""
    slots, at = [[] for _ in range(n)], 0
    while any(len(s) < 2 for s in slots):
        i = at % len(labels)
        at += 1
        for s in slots:
            if len(s) == 2:
                continue
            if not s or labels[s[0]] != labels[i]:
                s.append(i)
                break
    return [tuple(s) for s in slots]


@given(st.lists(st.integers(0, 3), min_size=2, max_size=30).filter(lambda x: len(set(x)) > 1), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_pairs_equal_the_slot_scan(labels, n):
    found = pair_up(labels, n)[0]
    assert sorted(found) == sorted(slot_scan(labels, n))
    assert all(labels[a] != labels[b] for a, b in found)


def test_single_class_raises(spark):
    with pytest.raises(ValueError):
        pair_up([0, 0, 0], 2)
    with pytest.raises(ValueError):
        HashBoost(2).fit_batch(spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], "id long, features array<double>, label int"))


def fitted(spark, rows=ROWS, **kwargs):
    booster = HashBoost(2, num_pairs=2, picker=lambda r, b, p: b, **kwargs)
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    return booster.fit_batch(df), df


def test_first_hash_by_hand(spark):
    booster, df = fitted(spark)
    # hardest first is by id: pairs (0, 2) and (1, 3) -> thresholds 1.0 and 3.0
    assert booster.model.midpoints.tolist() == [[1.0, 3.0]] and booster.model.features.tolist() == [[0, 1]]
    leaves = {(r["bucket"], r["class"]): r["leaf"] for r in booster.leaf_table(spark).collect()}
    assert np.isclose(leaves[1, 0], 0.19920279) and np.isclose(leaves[1, 1], -0.19920279) and np.isclose(leaves[2, 0], -0.19920279)
    proba = [r["proba"] for r in booster.predict_proba(df).orderBy("id").collect()]
    assert np.allclose(proba[:2], [[0.59830452, 0.40169548]] * 2) and np.allclose(proba[2:], [[0.40169548, 0.59830452]] * 2)


def test_training_doesnt_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist(), int(rng.integers(0, 3))) for i in range(60)]
    models = []
    for n in (1, 5):
        booster = HashBoost(3, num_pairs=3, seed=4)
        df = spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(n)
        for k in range(3):
            booster.fit_batch(df.where(F.col("id") % 3 == k))
        models.append(booster.model)
    assert np.allclose(models[0].g, models[1].g) and np.allclose(models[0].midpoints, models[1].midpoints)


def test_second_batch_uses_one_residual_snapshot(spark):
    booster, df = fitted(spark)
    before = booster.model.g.copy()
    proba = np.array([r["proba"] for r in booster.predict_proba(df).orderBy("id").collect()])
    booster.fit_batch(df)
    residual = proba - np.eye(2)[[0, 0, 1, 1]]
    assert np.allclose(booster.model.g[0, 1], before[0, 1] - residual[:2].sum(0))
    assert np.isclose(np.abs(booster.model.g[1]).sum(), np.abs(residual[:2].sum(0)).sum() * 2)


def test_stages_add_up_to_the_prediction(spark):
    booster, df = fitted(spark)
    booster.fit_batch(df)
    stages = booster.predict_all(df)
    sums = {(r["id"], r["class"]): r["z"] for r in stages.where("round > 0").groupBy("id", "class").agg(F.sum("logit").alias("z")).collect()}
    for r in booster.predict(df).collect():
        assert np.allclose([sums[r["id"], 0], sums[r["id"], 1]], r["logits"])
    assert np.isclose(stages.where("round = 0").first()["logit"], np.log(0.5))
    errors = {r["round"]: r["error_rate"] for r in metrics.staged_error(stages).collect()}
    assert errors == {0: 0.5, 1: 0.0, 2: 0.0}


def test_tables_round_trip(spark):
    booster, df = fitted(spark)
    again = HashBoost.from_tables(booster.splits(spark), booster.leaf_table(spark), 2)
    assert np.allclose(again.model.g, booster.model.g) and np.allclose(again.model.midpoints, booster.model.midpoints)


def test_limits(spark):
    booster, df = fitted(spark, max_hashes=1)
    with pytest.raises(ValueError, match="hashes"):
        booster.fit_batch(df)
    with pytest.raises(ValueError, match="labels"):
        HashBoost(2).fit_batch(spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 2)], "id long, features array<double>, label int"))
    assert HashBoost(2).predict(df).first()["logits"] == [0.0, 0.0]


def test_one_row_is_predicted(spark):
    booster, df = fitted(spark)
    assert booster.predict(df.limit(1)).count() == 1


def test_expressions(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.5], 1)], "z array<double>, label int")
    row = df.select(softmax(F.col("z")).alias("p"), "label").select("p", cross_entropy(F.col("p"), F.col("label")).alias("ce"), argmax(F.col("p")).alias("a")).first()
    e = np.exp([1, 1, 0.5])
    assert np.allclose(row["p"], e / e.sum()) and np.isclose(row["ce"], -np.log(e[1] / e.sum())) and row["a"] == 0
    assert spark.range(1).select(bucket(F.array(F.lit(0.0), F.lit(5.0)), [0, 1], [0.0, 1.0]).alias("b")).first()["b"] == 1
    worst = spark.range(1).select(clipped_log_loss(F.array(F.lit(0.0), F.lit(1.0)), F.lit(0)).alias("x")).first()["x"]
    assert np.isclose(worst, -np.log(1.1920929e-07))


def test_estimator_quota():
    assert estimator_quota(200, 3) == [67, 67, 66]
    assert estimator_quota(200, 16) == [13] * 8 + [12] * 8
    assert estimator_quota(200, 250) == [1] * 250


def test_learning_curve_falls(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(i % 2) + rng.normal() * 0.1, rng.normal()], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    found = learning_curve(HashBoost(2, num_pairs=3, seed=1), lambda e: [df], {"train": df}, 3)
    assert found[-1]["error_rate"] < 0.2 and found[-1]["batches"] == 3


def test_online_trainer_skips_replays(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, features array<double>, label int")
    trainer = OnlineTrainer(HashBoost(2, num_pairs=2, seed=1), f"{tmp_path}/state")
    trainer(df, 0)
    trainer(df, 0)
    assert trainer.booster.model.rounds == 1
    again = OnlineTrainer(HashBoost(2, num_pairs=2, seed=1), f"{tmp_path}/state")
    again(df, 0)
    assert again.booster.model.rounds == 1 and again.last_batch == 0
    again(df.where("label = 0"), 1)
    assert again.booster.model.rounds == 1 and again.last_batch == 1


def test_stream_until_it_ends(spark, tmp_path):
    spark.createDataFrame(ROWS, "id long, features array<double>, label int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, features array<double>, label int").parquet(str(tmp_path / "in"))
    trainer = OnlineTrainer(HashBoost(2, num_pairs=2, seed=1))
    trainer.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert trainer.booster.model.rounds >= 1
    again = OnlineTrainer(HashBoost(2, num_pairs=2, seed=1), trainer.state)
    again(spark.createDataFrame(ROWS, "id long, features array<double>, label int"), trainer.last_batch)
    assert np.allclose(again.booster.model.g, trainer.booster.model.g)


def test_update_without_a_new_hash(spark):
    booster, df = fitted(spark)
    splits = booster.splits(spark)
    fixed = HashBoost.from_tables(splits, booster.leaf_table(spark).where("false"), 2).update(df)
    assert np.allclose(fixed.model.g, booster.model.g) and fixed.model.rounds == 1
    assert np.allclose(fixed.update(df.where("false")).model.g, booster.model.g)
