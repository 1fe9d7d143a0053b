import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions.intervals import feature_count, make_intervals, representation_lengths
from strataloom.functions.series import REPRESENTATIONS, interval_quantiles, numpy_quantiles, numpy_representations
from strataloom.operators.quant import IntervalModel, Quant

INTERVALS = {
    1: [(0, 1)],
    2: [(0, 2), (0, 1), (1, 2)],
    3: [(0, 3), (0, 1), (1, 3)],
    5: [(0, 5), (0, 2), (2, 5), (2, 4), (0, 1), (1, 2), (2, 3), (3, 5)],
    6: [(0, 6), (0, 3), (3, 6), (2, 5), (0, 1), (1, 3), (3, 4), (4, 6)],
    7: [(0, 7), (0, 3), (3, 7), (2, 5), (0, 1), (1, 3), (3, 5), (5, 7), (1, 2), (2, 4), (4, 6)],
}


@pytest.mark.parametrize("length", INTERVALS)
def test_intervals_by_hand(length):
    assert make_intervals(length, 6) == INTERVALS[length]


@given(st.integers(1, 600), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_intervals_stay_inside(length, depth):
    assert all(0 <= a < b <= length for a, b in make_intervals(length, depth))


@pytest.mark.parametrize("length,total", [(8, 50), (16, 134), (24, 212), (32, 323), (64, 692), (128, 1160), (512, 4500)])
def test_feature_counts(length, total):
    assert Quant().num_features(length) == total
    assert sum(feature_count(n, 6, 4) for n in representation_lengths(length).values()) == total


QUANTILES = [([7], [7]), ([3, 1], [2]), ([4, 1, 3, 2], [2.5]), ([5, 1, 4, 2, 3], [1, 2]), ([9, 0, 8, 1, 7, 2, 6, 3, 5], [0, 5 - 41 / 9, 9]), (list(range(13)), [0, -2, 8, 6])]


@pytest.mark.parametrize("values,expected", QUANTILES)
def test_quantiles_by_hand(spark, values, expected):
    assert np.allclose(numpy_quantiles(np.array([values], float), depth=1)[0], expected)
    got = spark.createDataFrame([([float(v) for v in values],)], "x array<double>").select(interval_quantiles(F.col("x"), len(values), 1, 4).alias("q")).first()["q"]
    assert np.allclose(got[0], expected)


def test_representations_by_hand(spark):
    x = [1.0, 2, 4, 7, 11, 16]
    expected = {"identity": x, "smoothed_diff": [1.6, 2.2, 3.0, 3.8, 4.4], "second_diff": [1, 1, 1, 1], "spectrum": [41, 18.734994, 10.440307, 9]}
    df = spark.createDataFrame([([float(v) for v in x],)], "x array<float>")
    for name, want in expected.items():
        assert np.allclose(df.select(REPRESENTATIONS[name](F.col("x"), 6).alias("z")).first()["z"], want, atol=1e-6)
        assert np.allclose(numpy_representations(np.array([x]))[name][0], want, atol=1e-6)


@pytest.mark.parametrize("length", [3, 5, 17, 64])
def test_native_and_arrow_agree(spark, length):
    x = np.random.default_rng(length).normal(size=(7, length))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, series array<double>").repartition(3)
    native, arrow = ({r["id"]: r["features"] for r in Quant(method=m).transform(df).collect()} for m in ("native", "arrow"))
    for i in range(7):
        assert np.allclose(native[i], arrow[i], atol=1e-9) and len(native[i]) == Quant().num_features(length)


def test_channels(spark):
    x = np.random.default_rng(0).normal(size=(4, 2, 9))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, series array<array<double>>")
    native, arrow = (np.array([r["features"] for r in Quant(method=m).transform(df).orderBy("id").collect()]) for m in ("native", "arrow"))
    assert np.allclose(native, arrow, atol=1e-9) and native.shape[1] == 2 * Quant().num_features(9)
    one = np.array([r["features"] for r in Quant(method="arrow").transform(df.select("id", F.col("series")[1].alias("series"))).orderBy("id").collect()])
    k = 3  # features of the first interval of nine values; the first channel's come first, then the second's
    assert np.allclose(native[:, k : 2 * k], one[:, :k]) and np.allclose(native[:, :k], numpy_quantiles(x[:, 0], 6, 4)[:, :k])


def test_null_and_nan_make_features_null(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan"), 3.0, 4.0]), (1, [1.0, None, 3.0, 4.0]), (2, None)], "id int, series array<double>")
    for method in ("native", "arrow"):
        rows = [r["features"] for r in Quant(method=method, length=4).transform(df).orderBy("id").collect()]
        for features in rows[:2]:
            assert features[0] is None and features[2] is not None  # (0, 4) holds it, (2, 4) doesn't
        assert rows[2] is None


def test_bad_parameters(spark):
    for bad in ({"depth": 0}, {"div": 0}, {"method": "x"}):
        with pytest.raises(ValueError):
            Quant(**bad)
    with pytest.raises(ValueError):
        IntervalModel(8, depth=0)
    with pytest.raises(ValueError):
        representation_lengths(2)
    with pytest.raises(ValueError):
        Quant().transform(spark.createDataFrame([([1.0, 2.0],)], "series array<double>"))
    with pytest.raises(Exception, match="long"):
        Quant(length=4, method="native").transform(spark.createDataFrame([([1.0, 2.0, 3.0],)], "series array<double>")).collect()


def test_features_are_a_map_without_shuffle(spark):
    df = spark.range(3).select(F.array(*[F.rand(i) for i in range(8)]).alias("series"))
    plan = Quant(length=8, method="native").transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@given(st.lists(st.floats(-1e6, 1e6), min_size=3, max_size=40))
@settings(max_examples=60, deadline=None)
def test_quantiles_ascend_before_centring(values):
    x = np.array([values])
    q = numpy_quantiles(x, depth=1, div=1)[0]
    q[1::2] += x.mean() if len(values) > 1 else 0
    assert (np.diff(q) >= -1e-6).all()
