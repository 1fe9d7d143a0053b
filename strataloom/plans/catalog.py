"""Registered queries over the driver tables and their DuckDB equivalents.

Series come from `embeddings` (64 values, classes 0..9); `lineitem` serves as a larger feature matrix and `events` for
assembling series. Doubles are rounded to six places on both sides; adding 0.0 makes a negative zero positive.
"""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.boosting import bucket, clipped_log_loss, cross_entropy, hessians, one_hot, pick_feature, residuals, softmax
from strataloom.functions.intervals import make_intervals, representation_lengths
from strataloom.functions.series import REPRESENTATIONS, interval_quantiles, let
from strataloom.operators import metrics
from strataloom.operators.hashboost import HashBoost, learning_curve, pair_up
from strataloom.operators.ordering import shuffle_key, shuffle_key_sql, with_position
from strataloom.operators.quant import IntervalModel, Quant
from strataloom.sources.dataset import SeriesDataset, dense_labels, estimator_quota, read_fold, read_npy
from strataloom.sources.folders import shared_folder, write_bytes
from strataloom.sources.results import curve, results_document, write_results

LENGTH, CLASSES, DEPTH, DIV, SEED = 64, 10, 6, 4, 42
BITS, ROUNDS, LR, BATCH = 4, 3, 0.1, 64

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def dataset(spark: SparkSession, sf_dir: str, **kwargs) -> SeriesDataset:
    return SeriesDataset.from_table(embeddings(spark, sf_dir), "vec_id", "embedding", "label", **kwargs)


def rounded(value: Column | str) -> Column:
    return F.round(value, 6) + 0.0


def _key(seed: int = SEED, epoch: int = 0) -> str:
    return shuffle_key_sql("vec_id", seed, epoch)


# sources, selection, splitting, batching


@query("series_scan_shape", "select count(*)::bigint as n_rows, max(len(embedding))::int as length from embeddings")
def series_scan_shape(spark, sf_dir):
    return embeddings(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.max(F.size("embedding")).alias("length"))


@query("class_histogram", "select label, count(*)::bigint as n from embeddings group by label")
def class_histogram(spark, sf_dir):
    return embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("classes", "select distinct label from embeddings")
def classes(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in dataset(spark, sf_dir).classes], "label int")


@query("series_materialised", "select vec_id, (i - 1)::int as pos, embedding[i]::float::double as value, label::int as label from embeddings, range(1, 65) t(i)")
def series_materialised(spark, sf_dir):
    with_ids = dataset(spark, sf_dir).open()
    rows = with_ids.materialised().select(F.col("id").alias("vec_id"), F.posexplode("series").alias("pos", "value"), "label")
    with_ids.close()
    return rows.withColumn("value", F.col("value").cast("double"))


@query("fold_file", "select vec_id as id from embeddings where vec_id % 10 = 3")
def fold_file(spark, sf_dir):
    """A fold's ids written as text, one float a line, and read back."""
    at = shared_folder(spark, "fold")
    _fold(spark, sf_dir).select(F.format_string("%.18e", F.col("id").cast("double"))).write.text(at)
    return read_fold(spark, at)


@query("npy_scan", "select row_number() over (order by vec_id) - 1 as id, label::int as label, pos, value from (select vec_id, label, (i - 1)::int as pos, embedding[i]::float::double as value from embeddings, range(1, 65) t(i) where vec_id < 64) order by vec_id, pos".replace("row_number() over (order by vec_id) - 1 as id", "dense_rank() over (order by vec_id) - 1 as id"))
def npy_scan(spark, sf_dir):
    """64 series saved as .npy files and scanned again."""
    import numpy as np

    rows = embeddings(spark, sf_dir).where("vec_id < 64").orderBy("vec_id").collect()
    paths = []
    for values in (np.array([r["embedding"] for r in rows], np.float32), np.array([r["label"] for r in rows], np.int32)):
        held = io.BytesIO()
        np.save(held, values)
        paths.append(shared_folder(spark, "series") + ".npy")
        write_bytes(spark, paths[-1], held.getvalue())
    local = [p.removeprefix("file://").removeprefix("file:") for p in paths]
    return read_npy(spark, *local, rows_per_read=50).select("id", "label", F.posexplode("series").alias("pos", "value"))


@query("batch_gather", f"select batch_id, count(*)::bigint as n, min(vec_id) as first_id, sum(label)::bigint as labels from (select vec_id, label, ((row_number() over (order by {_key(epoch=0)}, vec_id) - 1) // {BATCH})::int as batch_id from embeddings) group by batch_id")
def batch_gather(spark, sf_dir):
    """The batches of an epoch one by one, as a learner gets them."""
    found = []
    for i, batch in enumerate(dataset(spark, sf_dir, batch_size=BATCH, seed=SEED)):
        found.append((i, *batch.agg(F.count("*"), F.min("id"), F.sum("label")).first()))
    return spark.createDataFrame(found, "batch_id int, n long, first_id long, labels long")


@query("positions_in_order", "select vec_id, row_number() over (order by vec_id) - 1 as position from embeddings")
def positions_in_order(spark, sf_dir):
    return dataset(spark, sf_dir, shuffle=False).positions().select(F.col("id").alias("vec_id"), F.col("position").cast("long").alias("position"))


@query("num_classes", "select count(distinct label)::bigint as num_classes from embeddings")
def num_classes(spark, sf_dir):
    return metrics.class_count(embeddings(spark, sf_dir))


@query("series_flatten_long", "select vec_id, (i - 1)::int as pos, embedding[i]::double as value from embeddings, range(1, 65) t(i)")
def series_flatten_long(spark, sf_dir):
    return dataset(spark, sf_dir).flat().select(F.col("id").alias("vec_id"), F.posexplode("features").alias("pos", "value"))


def _fold(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).where("vec_id % 10 = 3").select(F.col("vec_id").alias("id"))


@query("fold_exclusion", "select vec_id, label from embeddings where vec_id not in (select vec_id from embeddings where vec_id % 10 = 3)")
def fold_exclusion(spark, sf_dir):
    return dataset(spark, sf_dir).without(_fold(spark, sf_dir)).labels.select(F.col("id").alias("vec_id"), "label")


@query("fold_selection", "select vec_id, label from embeddings where vec_id in (select vec_id from embeddings where vec_id % 10 = 3)")
def fold_selection(spark, sf_dir):
    return dataset(spark, sf_dir)[_fold(spark, sf_dir)].labels.select(F.col("id").alias("vec_id"), "label")


@query(
    "split_train_val_test",
    f"""with p as (select vec_id, row_number() over (order by {_key()}, vec_id) - 1 as position, count(*) over () as n from embeddings where vec_id % 10 <> 3)
select vec_id, position::bigint as position, case when position * 100 < 80 * n then 'train' when position * 100 < 90 * n then 'valid' else 'test' end as split from p""",
)
def split_train_val_test(spark, sf_dir):
    rest = dataset(spark, sf_dir).without(_fold(spark, sf_dir)).df
    n = rest.count()
    at = with_position(rest, shuffle_key("id", SEED), "id")
    name = F.when(F.col("position") * 100 < 80 * n, "train").when(F.col("position") * 100 < 90 * n, "valid").otherwise("test")
    return at.select(F.col("id").alias("vec_id"), F.col("position").cast("long").alias("position"), name.alias("split"))


@query("batch_assignment", f"select vec_id, ((row_number() over (order by {_key(epoch=1)}, vec_id) - 1) // {BATCH})::int as batch_id from embeddings")
def batch_assignment(spark, sf_dir):
    return dataset(spark, sf_dir, batch_size=BATCH, seed=SEED).batches(1).select(F.col("id").alias("vec_id"), "batch_id")


@query(
    "estimator_quota",
    f"""with n as (select ceil(count(*) / {BATCH}.0)::bigint as b from embeddings), s as (select b, greatest(1, 200 // b) as share from n)
select i::int as batch_id, (share + case when i < greatest(0, 200 - share * b) then 1 else 0 end)::int as estimators from s, range(1000000) t(i) where i < b""",
)
def quota(spark, sf_dir):
    rows = list(enumerate(estimator_quota(200, dataset(spark, sf_dir, batch_size=BATCH).num_batches)))
    return spark.createDataFrame(rows, "batch_id int, estimators int")


@query("batch_rows_for_memory", "select greatest(1, (0.05 * 1048576)::bigint // (4 * max(len(embedding))))::int as batch_rows from embeddings")
def batch_rows_for_memory(spark, sf_dir):
    data = dataset(spark, sf_dir)
    data.set_batch_size(0.05)
    return spark.createDataFrame([(data.batch_size,)], "batch_rows int")


@query("series_head", f"select vec_id, label from embeddings order by {_key()}, vec_id limit 256")
def series_head(spark, sf_dir):
    return dataset(spark, sf_dir, seed=SEED).head(256).select(F.col("id").alias("vec_id"), "label")


@query("dense_label_index", "select l_orderkey, l_linenumber, (select count(distinct l_returnflag) from lineitem b where b.l_returnflag < a.l_returnflag)::int as label from lineitem a")
def dense_label_index(spark, sf_dir):
    rows, _ = dense_labels(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label")))
    return rows


@query(
    "events_daily_series",
    """with u as (select distinct user_id from events), d as (select user_id, datediff('day', timestamp '2024-01-01', ts)::int as day, sum(value) as total from events group by all)
select u.user_id, i::int as day, round(coalesce(total, 0.0), 6) + 0.0 as total from u cross join range(30) t(i) left join d on d.user_id = u.user_id and d.day = i""",
)
def events_daily_series(spark, sf_dir):
    """Series of 30 daily sums a user, zero where there was none (a way to get series out of a log)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day"), "value")
    sums = events.groupBy("user_id", "day").agg(F.sum("value").alias("total"))
    by_day = sums.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "total"))).alias("m"))
    series = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return by_day.select("user_id", F.posexplode(series).alias("day", "total")).select("user_id", "day", rounded("total").alias("total"))


# representations, intervals, quantiles

_VALUES = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings)"


def _repr_sql(n: int) -> dict[str, str]:
    """CTEs r_<kind> (vec_id, z) from v, for series of length n."""
    return {
        "identity": "r_identity as (select vec_id, x as z from v)",
        "smoothed_diff": f"""r_smoothed_diff as (select vec_id, list(m order by i) as z from (
 select vec_id, i, (d[greatest(i - 2, 1)] + d[greatest(i - 1, 1)] + d[i] + d[least(i + 1, {n - 1})] + d[least(i + 2, {n - 1})]) / 5.0 as m
 from (select vec_id, [x[j + 1] - x[j] for j in range(1, {n})] as d from v), range(1, {n}) t(i)) group by vec_id)""",
        "second_diff": f"r_second_diff as (select vec_id, [(x[j + 2] - x[j + 1]) - (x[j + 1] - x[j]) for j in range(1, {n - 1})] as z from v)",
        "spectrum": f"""r_spectrum as (select vec_id, list(m order by k) as z from (
 select vec_id, k, sqrt(power(sum(x[i + 1] * cos(2 * pi() * ((k * i) % {n}) / {n})), 2) + power(sum(x[i + 1] * sin(2 * pi() * ((k * i) % {n}) / {n})), 2)) as m
 from v, range({n // 2 + 1}) f(k), range({n}) t(i) group by vec_id, k) group by vec_id)""",
    }


_REPR = _repr_sql(LENGTH)


def _interval_sql(length: int) -> str:
    """Interval table of a length: level by level, pieces then shifted pieces, numbered from 0."""
    return f"""(select (row_number() over (order by level, moved, i) - 1)::int as idx, a::int as a, b::int as b from (
 select level, 0 as moved, i, i * {length} // n as a, (i + 1) * {length} // n as b from (select k as level, (1 << k) as n from range({DEPTH}) t(k) where (1 << k) <= {length}), range(64) u(i) where i < n
 union all
 select level, 1, i, i * {length} // n + s, (i + 1) * {length} // n + s from (select k as level, (1 << k) as n, ({length} + 2 * (1 << k) - 1) // (2 * (1 << k)) as s from range(1, {DEPTH}) t(k) where (1 << k) <= {length}
  and {length} // (1 << k) + case when (1 << k) - {length} % (1 << k) > ((1 << k) - 1) // 2 then 0 else 1 end > 1), range(64) u(i) where i < n - 1))"""


def _quantile_sql(kind: str, length: int = LENGTH) -> str:
    """CTE q_<kind>: (vec_id, idx, q, value) of all intervals, from r_<kind>."""
    return f"""q_{kind} as (select vec_id, idx, q::int as q, s[1 + lo] + (place - lo) * (s[1 + least(lo + 1, m - 1)] - s[1 + lo]) - case when k > 1 and q % 2 = 1 then mean else 0 end as value from (
 select vec_id, idx, m, k, s, mean, q, case when k = 1 then (m - 1) / 2.0::double else (m - 1) * q / (k - 1)::double end as place, floor(case when k = 1 then (m - 1) / 2.0::double else (m - 1) * q / (k - 1)::double end)::int as lo from (
  select vec_id, idx, b - a as m, case when b - a = 1 then 1 else 1 + (b - a - 1) // {DIV} end as k, list_sort(z[a + 1:b]) as s, list_sum(z[a + 1:b]) / (b - a) as mean from r_{kind}, {_interval_sql(representation_lengths(length)[kind])} i), range(64) t(q) where q < k))"""


def _representation(kind: str) -> Query:
    def run(spark, sf_dir):
        rows = embeddings(spark, sf_dir).select("vec_id", REPRESENTATIONS[kind](F.col("embedding"), LENGTH).alias("z"))
        return rows.select("vec_id", F.posexplode("z").alias("pos", "value")).select("vec_id", "pos", rounded("value").alias("value"))

    return run


def _quantiles(kind: str) -> Query:
    def run(spark, sf_dir):
        n = representation_lengths(LENGTH)[kind]
        rows = embeddings(spark, sf_dir).select("vec_id", let(REPRESENTATIONS[kind](F.col("embedding"), LENGTH), lambda z: interval_quantiles(z, n, DEPTH, DIV)).alias("f"))
        rows = rows.select("vec_id", F.posexplode("f").alias("idx", "own")).select("vec_id", "idx", F.posexplode("own").alias("q", "value"))
        return rows.select("vec_id", "idx", "q", rounded("value").alias("value"))

    return run


for _kind, _n in representation_lengths(LENGTH).items():
    query(f"repr_{_kind}", f"with {_VALUES}, {_REPR[_kind]} select vec_id, (i - 1)::int as pos, round(z[i], 6) + 0.0 as value from r_{_kind}, range(1, {_n + 1}) t(i)")(_representation(_kind))
    query(f"interval_quantiles_{_kind}", f"with {_VALUES}, {_REPR[_kind]}, {_quantile_sql(_kind)} select vec_id, idx, q, round(value, 6) + 0.0 as value from q_{_kind}")(_quantiles(_kind))


@query("interval_table", " union all ".join(f"select '{k}' as representation, idx, a, b from {_interval_sql(n)}" for k, n in representation_lengths(LENGTH).items()))
def interval_table(spark, sf_dir):
    rows = [(kind, i, a, b) for kind, n in representation_lengths(LENGTH).items() for i, (a, b) in enumerate(make_intervals(n, DEPTH))]
    return spark.createDataFrame(rows, "representation string, idx int, a int, b int")


_WIDE = f"""with {_VALUES}, {', '.join(f'{_REPR[k]}, {_quantile_sql(k)}' for k in _REPR)},
 every as ({' union all '.join(f'select vec_id, {i} as rep, idx, q, value from q_{k}' for i, k in enumerate(_REPR))})
select vec_id, (row_number() over (partition by vec_id order by rep, idx, q) - 1)::int as feature, round(value, 6) + 0.0 as value from every"""


def _wide(method: str) -> Query:
    def run(spark, sf_dir):
        rows = Quant(inputCol="embedding", depth=DEPTH, div=DIV, length=LENGTH, method=method).transform(embeddings(spark, sf_dir))
        return rows.select("vec_id", F.posexplode("features").alias("feature", "value")).select("vec_id", "feature", rounded("value").alias("value"))

    return run


query("quant_features_wide", _WIDE)(_wide("auto"))  # the native way is held against SQL by quant_two_channels
query("quant_features_arrow", _WIDE)(_wide("arrow"))



@query("interval_model", f"with {_VALUES}, {_REPR['identity']}, {_quantile_sql('identity')} select vec_id, (row_number() over (partition by vec_id order by idx, q) - 1)::int as feature, round(value, 6) + 0.0 as value from q_identity")
def interval_model(spark, sf_dir):
    rows = embeddings(spark, sf_dir).withColumn("z", REPRESENTATIONS["identity"](F.col("embedding"), LENGTH))
    model = IntervalModel(LENGTH, DEPTH, DIV).fit(rows)
    return rows.select("vec_id", F.posexplode(model.transform(F.col("z"))).alias("feature", "value")).select("vec_id", "feature", rounded("value").alias("value"))


# two channels of 32: channel c of series i is series 2 * i + c for the CTEs
_HALF = LENGTH // 2
_TWO = f"""with v as (select vec_id * 2 + c as vec_id, list_transform(embedding[c * {_HALF} + 1:c * {_HALF} + {_HALF}], lambda x: x::double) as x from embeddings, range(2) t(c)),
 {', '.join(f'{sql}, {_quantile_sql(k, _HALF)}' for k, sql in _repr_sql(_HALF).items())},
 every as ({' union all '.join(f'select vec_id, {i} as rep, idx, q, value from q_{k}' for i, k in enumerate(_REPR))})
select (vec_id // 2)::bigint as vec_id, (row_number() over (partition by vec_id // 2 order by rep, idx, vec_id % 2, q) - 1)::int as feature, round(value, 6) + 0.0 as value from every"""


def _two_channels(method: str) -> Query:
    def run(spark, sf_dir):
        channels = F.array(F.slice("embedding", 1, _HALF), F.slice("embedding", _HALF + 1, _HALF))
        rows = Quant(inputCol="series", depth=DEPTH, div=DIV, length=_HALF, method=method).transform(embeddings(spark, sf_dir).select("vec_id", channels.alias("series")))
        return rows.select("vec_id", F.posexplode("features").alias("feature", "value")).select("vec_id", "feature", rounded("value").alias("value"))

    return run


query("quant_two_channels", _TWO)(_two_channels("native"))
query("quant_two_channels_arrow", _TWO)(_two_channels("arrow"))

# booster steps. Demonstration logits: five times the first ten values of a series

_PROBA = f"""l as (select vec_id, label, c::int as cls, 5 * embedding[c + 1]::double as z from embeddings, range({CLASSES}) t(c)),
 e as (select vec_id, label, cls, exp(z - max(z) over (partition by vec_id)) as e from l),
 p as (select vec_id, label, cls, e / sum(e) over (partition by vec_id) as p from e)"""


def demo_proba(spark, sf_dir) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, CLASSES), lambda x: 5 * x.cast("double"))
    return embeddings(spark, sf_dir).select("vec_id", "label", softmax(logits).alias("proba"))


@query("softmax_xent", f"with {_PROBA} select vec_id, label, round(-ln(p), 6) + 0.0 as ce from p where cls = label")
def softmax_xent(spark, sf_dir):
    return demo_proba(spark, sf_dir).select("vec_id", "label", rounded(cross_entropy(F.col("proba"), F.col("label"))).alias("ce"))


@query(
    "onehot_residual_hessian",
    f"with {_PROBA} select vec_id, cls as class, (cls = label)::int as one_hot, round(p - (cls = label)::int, 6) + 0.0 as residual, round(p * (1 - p) + 1e-3, 6) + 0.0 as hessian from p",
)
def onehot_residual_hessian(spark, sf_dir):
    rows = demo_proba(spark, sf_dir)
    zipped = F.arrays_zip(one_hot(F.col("label"), CLASSES).alias("o"), residuals(F.col("proba"), F.col("label")).alias("r"), hessians(F.col("proba")).alias("h"))
    return rows.select("vec_id", F.posexplode(zipped).alias("class", "x")).select("vec_id", "class", F.col("x.o").alias("one_hot"), rounded("x.r").alias("residual"), rounded("x.h").alias("hessian"))


@query("hardest_examples", f"with {_PROBA} select vec_id, label, round(-ln(p), 6) + 0.0 as ce from p where cls = label order by -ln(p) desc, vec_id limit 32")
def hardest_examples(spark, sf_dir):
    rows = demo_proba(spark, sf_dir).withColumn("ce", cross_entropy(F.col("proba"), F.col("label")))
    return rows.orderBy(F.desc("ce"), "vec_id").limit(32).select("vec_id", "label", rounded("ce").alias("ce"))


def _pairs_sql(name: str, ranked: str, want: int) -> str:
    """CTEs p_<name> (pair, first, second: ids) from CTE `ranked` (l: labels, ids; hardest first), as a queue that each step puts at most one row into."""
    here = f"(i % len(l))::int"
    other = f"len(waiting) > 0 and l[waiting[1] + 1] <> l[{here} + 1]"
    return f"""s_{name} as (select 0 as i, []::int[] as waiting, []::int[][] as pairs union all
 select i + 1, case when {other} then waiting[2:] when len(waiting) + len(pairs) < {want} then list_append(waiting, {here}) else waiting end, case when {other} then list_append(pairs, [waiting[1], {here}]) else pairs end
 from s_{name}, {ranked} where len(pairs) < {want}),
 p_{name} as (select (k - 1)::int as pair, ids[pairs[k][1] + 1] as first, ids[pairs[k][2] + 1] as second from s_{name}, {ranked}, range(1, {want + 1}) t(k) where len(pairs) = {want})"""


@query(
    "hardest_pairs",
    f"with recursive {_PROBA}, top as (select vec_id, label, -ln(p) as ce from p where cls = label order by -ln(p) desc, vec_id limit 32), ranked as (select list(label order by ce desc, vec_id) as l, list(vec_id order by ce desc, vec_id) as ids from top), {_pairs_sql('hard', 'ranked', 8)} select * from p_hard",
)
def hardest_pairs(spark, sf_dir):
    """Eight pairs of hard rows of different classes."""
    top = hardest_examples(spark, sf_dir).orderBy(F.desc("ce"), "vec_id").collect()  # 32 rows
    pairs, _ = pair_up([r["label"] for r in top], 8)
    return spark.createDataFrame([(i, top[a]["vec_id"], top[b]["vec_id"]) for i, (a, b) in enumerate(pairs)], "pair int, first long, second long")


PICKED = [[pick_feature(SEED, r, b, LENGTH) for b in range(BITS)] for r in range(ROUNDS)]
MIDPOINTS = [[round(0.02 * ((r + b) % 3 - 1), 2) for b in range(BITS)] for r in range(ROUNDS)]


def _bucket_sql(r: int, x: str = "embedding") -> str:
    return "(" + " + ".join(f"case when {x}[{f + 1}]::double <= {m} then {1 << b} else 0 end" for b, (f, m) in enumerate(zip(PICKED[r], MIDPOINTS[r], strict=True))) + ")::int"


def bucketed(df: DataFrame) -> DataFrame:
    """(vec_id, label, round, bucket) for each of the demonstration hashes."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    wide = df.select("vec_id", "label", let(x, lambda v: F.array(*(bucket(v, PICKED[r], MIDPOINTS[r]) for r in range(ROUNDS)))).alias("b"))
    return wide.select("vec_id", "label", F.posexplode("b").alias("round", "bucket"))


_BUCKETS = "b as (" + " union all ".join(f"select vec_id, label, {r}::int as round, {_bucket_sql(r)} as bucket from embeddings" for r in range(ROUNDS)) + ")"


@query("hash_bucket", f"with {_BUCKETS} select vec_id, round, bucket from b")
def hash_bucket(spark, sf_dir):
    return bucketed(embeddings(spark, sf_dir)).select("vec_id", "round", "bucket")


def flat(spark, sf_dir) -> DataFrame:
    """(id, features, label): the values of a series as they are."""
    return dataset(spark, sf_dir).flat()


def demo_booster(spark) -> HashBoost:
    """The demonstration hashes with nothing learned."""
    splits = spark.createDataFrame([(r, b, PICKED[r][b], MIDPOINTS[r][b]) for r in range(ROUNDS) for b in range(BITS)], "round int, bit int, feature int, midpoint double")
    return HashBoost.from_tables(splits, spark.createDataFrame([], "round int, bucket int, class int, g double, h double"), CLASSES, LR)


def leaves_of(booster: HashBoost, spark) -> DataFrame:
    return booster.leaf_table(spark).select("round", "bucket", "class", rounded("g").alias("g"), rounded("h").alias("h"), rounded("leaf").alias("leaf"))


def _cells_sql(where: str = "true", name: str = "cells") -> str:
    """Sums before anything was learned: all classes have the probability 1 / K."""
    return f"""{name} as (select round, bucket, c::int as class, -sum({1.0 / CLASSES} - (c = label)::int) as g, sum({1.0 / CLASSES} * (1 - {1.0 / CLASSES}) + 1e-3) as h from b, range({CLASSES}) t(c) where {where} group by round, bucket, c)"""


_LEAVES = f"select round, bucket, class, round(g, 6) + 0.0 as g, round(h, 6) + 0.0 as h, round(g / (h + 1e-6) * {LR}, 6) + 0.0 as leaf from"


@query("hash_leaf_table", f"with {_BUCKETS}, {_cells_sql()} {_LEAVES} cells")
def hash_leaf_table(spark, sf_dir):
    return leaves_of(demo_booster(spark).update(flat(spark, sf_dir)), spark)


@query(
    "hash_leaf_update",
    f"""with {_BUCKETS}, {_cells_sql('vec_id % 2 = 0', 'old')},
 z as (select b.vec_id, b.label, c::int as class, sum(coalesce(g / (h + 1e-6) * {LR}, 0)) as z from b cross join range({CLASSES}) t(c) left join old o on o.round = b.round and o.bucket = b.bucket and o.class = c where vec_id % 2 = 1 group by all),
 e as (select *, exp(z - max(z) over (partition by vec_id)) as e from z), p as (select vec_id, label, class, e / sum(e) over (partition by vec_id) as p from e),
 more as (select round, bucket, class, -sum(p - (class = p.label)::int) as g, sum(p * (1 - p) + 1e-3) as h from b join p on p.vec_id = b.vec_id group by all),
 merged as (select round, bucket, class, sum(g) as g, sum(h) as h from (select * from old union all select * from more) group by all)
{_LEAVES} merged""",
)
def hash_leaf_update(spark, sf_dir):
    """A second batch, whose probabilities are no longer uniform, added to the sums of the first."""
    rows = flat(spark, sf_dir)
    booster = demo_booster(spark)
    for k in (0, 1):
        booster.update(rows.where(F.col("id") % 2 == k))
    return leaves_of(booster, spark)


def _training_sql(batches: list[str], bits: int, seed: int = SEED, lr: float = LR) -> str:
    """CTEs of a training, a hash a batch (conditions on vec_id): x, and for each t sp_t (splits) and ce_t (sums) before batch t, after the last as well."""
    out = ["x as materialized (select vec_id, label, list_transform(embedding, lambda v: v::double) as x from embeddings)", "sp_0 as (select 0 as round, 0 as bit, 0 as feature, 0.0::double as midpoint where false)", "ce_0 as (select 0 as round, 0 as bucket, 0 as class, 0.0::double as g, 0.0::double as h where false)"]
    for t, where in enumerate(batches):
        features = " ".join(f"when {b} then {pick_feature(seed, t, b, LENGTH)}" for b in range(bits))
        out += [
            f"rows_{t} as materialized (select * from x where {where})",
            _logits_sql(f"{t}", f"rows_{t}", t, lr),
            f"ranked_{t} as materialized (select list(label order by round(-ln(p), 9) desc, vec_id) as l, list(vec_id order by round(-ln(p), 9) desc, vec_id) as ids from pr_{t} where class = label)",
            _pairs_sql(f"{t}", f"ranked_{t}", bits),
            f"new_{t} as materialized (select {t} as round, pair as bit, feature, (a.x[feature + 1] + b.x[feature + 1]) / 2 as midpoint from (select *, case pair {features} end as feature from p_{t}) join x a on a.vec_id = first join x b on b.vec_id = second)",
            f"sp_{t + 1} as materialized (select * from sp_{t} union all select * from new_{t})",
            _buckets_sql(f"all_{t}", f"rows_{t}", f"sp_{t + 1}"),
            f"sm_{t} as (select round, bucket, class, -sum(p - (class = p.label)::int) as g, sum(p * (1 - p) + 1e-3) as h from bk_all_{t} b join pr_{t} p on p.vec_id = b.vec_id group by all)",
            f"ce_{t + 1} as materialized (select round, bucket, class, sum(g) as g, sum(h) as h from (select * from ce_{t} union all select * from sm_{t}) group by all)",
        ]
    return ",\n".join(out)


def _buckets_sql(name: str, rows: str, splits: str) -> str:
    return f"bk_{name} as materialized (select vec_id, label, round, sum(case when x[feature + 1] <= midpoint then 1 << bit else 0 end)::int as bucket from {rows}, {splits} group by vec_id, label, round)"


def _logits_sql(name: str, rows: str, t: int, lr: float = LR) -> str:
    """CTE pr_<name> (vec_id, label, class, p) of rows under the model before batch t."""
    return f"""{_buckets_sql(name, rows, f"sp_{t}")},
 lg_{name} as (select r.vec_id, r.label, c::int as class, coalesce(sum(g / (h + 1e-6) * {lr}), 0) as z from {rows} r cross join range({CLASSES}) k(c) left join bk_{name} b on b.vec_id = r.vec_id left join ce_{t} o on o.round = b.round and o.bucket = b.bucket and o.class = c group by r.vec_id, r.label, c),
 ex_{name} as (select *, exp(z - max(z) over (partition by vec_id)) as e from lg_{name}),
 pr_{name} as materialized (select vec_id, label, class, e / sum(e) over (partition by vec_id) as p from ex_{name})"""


_THREE = ["vec_id % 3 = 0", "vec_id % 3 = 1", "vec_id % 3 = 2"]


def _fitted(spark, sf_dir) -> HashBoost:
    rows, booster = flat(spark, sf_dir).persist(), HashBoost(CLASSES, num_pairs=BITS, lr=LR, seed=SEED)
    for k in range(3):
        booster.fit_batch(rows.where(F.col("id") % 3 == k))
    rows.unpersist()
    return booster


@query("hashboost_fit_leaves", f"with recursive {_training_sql(_THREE, BITS)} {_LEAVES} ce_3")
def hashboost_fit_leaves(spark, sf_dir):
    """Three batches, a hash each: all earlier hashes are updated and a new one is made from the hardest rows."""
    return leaves_of(_fitted(spark, sf_dir), spark)


@query("hashboost_fit_splits", f"with recursive {_training_sql(_THREE, BITS)} select round, bit, feature::int as feature, round(midpoint, 6) + 0.0 as midpoint from sp_3")
def hashboost_fit_splits(spark, sf_dir):
    return _fitted(spark, sf_dir).splits(spark).select("round", "bit", "feature", rounded("midpoint").alias("midpoint"))


_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_MIDPOINTS = [25.0, 30000.0, 0.05, 0.04]


@query(
    "lineitem_hash_leaves",
    f"""with r as (select l_returnflag as label, ({' + '.join(f'case when {c} <= {m} then {1 << b} else 0 end' for b, (c, m) in enumerate(zip(_LINE_FEATURES, _LINE_MIDPOINTS, strict=True)))})::int as bucket from lineitem),
 k as (select distinct l_returnflag as class from lineitem), n as (select count(*) as k from k)
select bucket, class, round(-sum(1.0::double / n.k - (class = label)::int) / (sum(1.0::double / n.k * (1 - 1.0::double / n.k) + 1e-3) + 1e-6) * {LR}, 6) + 0.0 as leaf from r, k, n group by bucket, class""",
)
def lineitem_hash_leaves(spark, sf_dir):
    """One hash over a larger feature matrix, class by return flag: one partial aggregation, then cells by class."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.array(*(F.col(c).cast("double") for c in _LINE_FEATURES)).alias("x"), F.col("l_returnflag").alias("label"))
    counts = rows.select(bucket(F.col("x"), [0, 1, 2, 3], _LINE_MIDPOINTS).alias("bucket"), "label").groupBy("bucket", "label").agg(F.count("*").alias("n"))
    classes = [r[0] for r in counts.select("label").distinct().orderBy("label").collect()]  # one row a class
    p = 1.0 / max(1, len(classes))
    cells = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m")).select("bucket", "n", "m", F.explode(F.array(*map(F.lit, classes))).alias("class"))
    g = -(F.col("n") * p - F.coalesce(F.try_element_at("m", F.col("class")), F.lit(0)))
    return cells.select("bucket", "class", rounded(g / (F.col("n") * (p * (1 - p) + 1e-3) + 1e-6) * LR).alias("leaf"))


# prediction with the demonstration hashes

_STAGES = f"""{_BUCKETS}, {_cells_sql()},
 s as (select vec_id, label, 0 as round, c::int as class, ln(1.0::double / {CLASSES}) as logit from embeddings, range({CLASSES}) t(c)
  union all select b.vec_id, b.label, b.round + 1, k.class, k.g / (k.h + 1e-6) * {LR} from b join cells k on k.round = b.round and k.bucket = b.bucket),
 z as (select vec_id, label, class, sum(logit) as logit from s where round > 0 group by vec_id, label, class),
 x as (select *, exp(logit - max(logit) over (partition by vec_id)) as e from z),
 p as (select vec_id, label, class, e / sum(e) over (partition by vec_id) as p from x),
 a as (select vec_id, label, class as prediction from (select *, row_number() over (partition by vec_id order by round(logit, 9) desc, class) as rn from z) where rn = 1)"""


def demo(spark, sf_dir) -> tuple[HashBoost, DataFrame]:
    """The demonstration hashes, which have learned from all rows, and the rows."""
    rows = flat(spark, sf_dir)
    return demo_booster(spark).update(rows), rows


def stages(spark, sf_dir) -> DataFrame:
    """(id, label, round, class, logit)"""
    booster, rows = demo(spark, sf_dir)
    return booster.predict_all(rows)


@query("predict_logits", f"with {_STAGES} select vec_id, class, round(logit, 6) + 0.0 as logit from z")
def predict_logits(spark, sf_dir):
    booster, rows = demo(spark, sf_dir)
    rows = booster.predict(rows).select(F.col("id").alias("vec_id"), F.posexplode("logits").alias("class", "logit"))
    return rows.select("vec_id", "class", rounded("logit").alias("logit"))


@query("predict_proba", f"with {_STAGES} select vec_id, class, round(p, 6) + 0.0 as proba from p")
def predict_proba(spark, sf_dir):
    booster, rows = demo(spark, sf_dir)
    rows = booster.predict_proba(rows).select(F.col("id").alias("vec_id"), F.posexplode("proba").alias("class", "proba"))
    return rows.select("vec_id", "class", rounded("proba").alias("proba"))


def predictions(spark, sf_dir) -> DataFrame:
    booster, rows = demo(spark, sf_dir)
    return booster.predict_proba(booster.predict(rows)).select("id", "label", "proba", metrics.label_of(F.col("logits")).alias("prediction"))


@query("predict_label", f"with {_STAGES} select vec_id, prediction from a")
def predict_label(spark, sf_dir):
    return predictions(spark, sf_dir).select(F.col("id").alias("vec_id"), "prediction")


@query(
    "predict_staged",
    f"with {_STAGES} select vec_id, round::int as round, class, round(logit, 6) + 0.0 as logit, round(sum(logit) over (partition by vec_id, class order by round), 6) + 0.0 as running from s",
)
def predict_staged(spark, sf_dir):
    running = F.sum("logit").over(Window.partitionBy("id", "class").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stages(spark, sf_dir).select(F.col("id").alias("vec_id"), "round", "class", rounded("logit").alias("logit"), rounded(running).alias("running"))


_STAGED_ERROR = f"""{_STAGES}, t as (select vec_id, label, round, class, round(sum(logit) over (partition by vec_id, class order by round), 9) as total from s),
 w as (select vec_id, label, round, class, row_number() over (partition by vec_id, round order by total desc, class) as rn from t),
 err as (select round::int as round, count(*)::bigint as n, avg((class <> label)::int::double) as error_rate from w where rn = 1 group by round)"""


def staged(spark, sf_dir) -> DataFrame:
    return metrics.staged_error(stages(spark, sf_dir))


@query("predict_staged_error", f"with {_STAGED_ERROR} select round, n, round(error_rate, 6) + 0.0 as error_rate from err")
def predict_staged_error(spark, sf_dir):
    return staged(spark, sf_dir).select("round", "n", rounded("error_rate").alias("error_rate"))


@query("best_and_last_round", f"with {_STAGED_ERROR} select round(min(error_rate), 6) + 0.0 as best, arg_min(round, (error_rate, round))::int as best_at, round(arg_max(error_rate, round), 6) + 0.0 as last from err")
def best_and_last_round(spark, sf_dir):
    return metrics.best_and_last(staged(spark, sf_dir), "round", "error_rate").select(rounded("best").alias("best"), "best_at", rounded("last").alias("last"))


@query("error_curve", f"with {_STAGED_ERROR} select string_agg(round::varchar, ',' order by round) as x, string_agg(format('{{:.6f}}', error_rate), ',' order by round) as y from err")
def error_curve(spark, sf_dir):
    points = curve(staged(spark, sf_dir), "round", "error_rate")
    return points.select(F.array_join(F.transform("curve.x", lambda v: v.cast("string")), ",").alias("x"), F.array_join(F.transform("curve.y", lambda v: F.format_string("%.6f", v)), ",").alias("y"))


@query("error_rate", f"with {_STAGES} select count(*)::bigint as n, round(avg((prediction <> label)::int::double), 6) + 0.0 as error_rate from a")
def error_rate(spark, sf_dir):
    return metrics.error_rate(predictions(spark, sf_dir)).select("n", rounded("error_rate").alias("error_rate"))


@query("log_loss", f"with {_STAGES} select count(*)::bigint as n, round(avg(-ln(least(greatest(p, 1.1920929e-07), 1 - 1.1920929e-07))), 6) + 0.0 as log_loss from p where class = label")
def log_loss(spark, sf_dir):
    return metrics.log_loss(predictions(spark, sf_dir)).select("n", rounded("log_loss").alias("log_loss"))


@query("confusion_matrix", f"with {_STAGES} select label, prediction, count(*)::bigint as n from a group by label, prediction")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir))


@query("error_by_class", f"with {_STAGES} select label, count(*)::bigint as n, round(avg((prediction <> label)::int::double), 6) + 0.0 as error_rate from a group by label")
def error_by_class(spark, sf_dir):
    return metrics.error_rate(predictions(spark, sf_dir), "prediction", "label", "label").select("label", "n", rounded("error_rate").alias("error_rate"))


@query("batch_log_loss", f"with {_PROBA} select count(*)::bigint as n, round(avg(-ln(least(greatest(p, 1.1920929e-07), 1 - 1.1920929e-07))), 6) + 0.0 as log_loss from p where cls = label")
def batch_log_loss(spark, sf_dir):
    return demo_proba(spark, sf_dir).agg(F.count("*").alias("n"), rounded(F.avg(clipped_log_loss(F.col("proba"), F.col("label")))).alias("log_loss"))


# learners. They choose at random or go through batches one by one: tested by properties and small cases instead of SQL


def featured(spark, sf_dir, **kwargs) -> DataFrame:
    rows = dataset(spark, sf_dir).df
    return Quant(length=LENGTH, **kwargs).transform(rows).select("id", "features", "label")


def _splits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = shuffle_key("id", SEED)
    return rows.where(key < 0.8 * (1 << 32)), rows.where(key >= 0.8 * (1 << 32))


_IN_TRAIN = f"{_key()} < {0.8 * (1 << 32)}"
_EPOCH_BATCHES = [f"{_IN_TRAIN} and ({_key(epoch=e)} // 1024) % 4 = {i}" for e in range(2) for i in range(4)]


def _errors_sql(t: int) -> str:
    """CTE er_<t> (split, error_rate) under the model before batch t."""
    return f"""{_logits_sql(f'eval_{t}', 'x', t)},
 be_{t} as (select *, row_number() over (partition by vec_id order by round(p, 9) desc, class) as rn from pr_eval_{t}),
 er_{t} as (select case when {_IN_TRAIN} then 'train' else 'valid' end as split, {t // 4 - 1} as epoch, {t} as batches, round(avg((class <> label)::int::double), 6) + 0.0 as error_rate from be_{t} where rn = 1 group by 1)"""


@query("hashboost_train_curve", f"with recursive {_training_sql(_EPOCH_BATCHES, 6)}, {_errors_sql(4)}, {_errors_sql(8)} select * from er_4 union all select * from er_8")
def hashboost_train_curve(spark, sf_dir):
    """Two epochs of four batches over the values as they are; error rates of both splits after each."""
    rows = flat(spark, sf_dir).persist()
    train, valid = _splits(rows)
    booster = HashBoost(CLASSES, num_pairs=6, lr=LR, seed=SEED)
    batch = lambda epoch: [train.where(F.pmod(F.floor(shuffle_key("id", SEED, epoch) / 1024), F.lit(4)) == i) for i in range(4)]
    found = learning_curve(booster, batch, {"train": train, "valid": valid}, epochs=2)
    rows.unpersist()
    made = spark.createDataFrame([(r["split"], r["epoch"], r["batches"], r["error_rate"]) for r in found], "split string, epoch int, batches int, error_rate double")
    return made.withColumn("error_rate", rounded("error_rate"))


# a forest of given trees: three tests, four leaves each, in which one class has 0.55 and all others 0.05


def _tests(tree: int) -> list[tuple[int, float]]:
    return [((97 * tree + 31 * node) % 692, round(0.0021 + 0.013 * (node - 1), 4)) for node in range(3)]


def _given_trees() -> list:
    import numpy as np

    from strataloom.operators.forest import Tree

    trees = []
    for t in range(3):
        (a, x), (b, y), (c, z) = _tests(t)
        shares = np.full((7, CLASSES), 0.05)
        shares[np.arange(3, 7), (4 * t + np.arange(4)) % CLASSES] = 0.55
        trees.append(Tree(np.array([a, b, c, -1, -1, -1, -1]), np.array([x, y, z, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]), shares))
    return trees


def _leaf_sql(t: int) -> str:
    (a, x), (b, y), (c, z) = _tests(t)
    return f"({4 * t} + case when f[{a + 1}] <= {x} then case when f[{b + 1}] <= {y} then 0 else 1 end else case when f[{c + 1}] <= {z} then 2 else 3 end end) % {CLASSES}"


_FOREST = f"""{_WIDE[: _WIDE.rindex("select vec_id, (row_number()")]}, w as (select vec_id, list(value order by rep, idx, q) as f from every group by vec_id),
 k as (select vec_id, [{', '.join(_leaf_sql(t) for t in range(3))}] as own from w),
 p as (select k.vec_id, e.label, c::int as class, ({' + '.join(f'case when own[{t + 1}] = c then 0.55 else 0.05 end' for t in range(3))})::double / 3 as p from k join embeddings e on e.vec_id = k.vec_id cross join range({CLASSES}) t(c)),
 a as (select * from (select *, row_number() over (partition by vec_id order by round(p, 9) desc, class) as rn from p) where rn = 1)"""


def _forest():
    from strataloom.operators.forest import QuantForest

    return QuantForest.from_trees(_given_trees(), CLASSES, depth=DEPTH, div=DIV)


@query("forest_proba", f"{_FOREST} select vec_id, class, round(p, 6) + 0.0 as proba from p")
def forest_proba(spark, sf_dir):
    rows = _forest().predict_proba(dataset(spark, sf_dir).df).select(F.col("id").alias("vec_id"), F.posexplode("proba").alias("class", "proba"))
    return rows.select("vec_id", "class", rounded("proba").alias("proba"))


@query(
    "forest_scores",
    f"{_FOREST} select round((select avg((class <> label)::int::double) from a), 6) + 0.0 as error_rate, round(avg(-ln(least(greatest(p, 1.1920929e-07), 1 - 1.1920929e-07))), 6) + 0.0 as log_loss from p where class = label",
)
def forest_scores(spark, sf_dir):
    error, loss = _forest().score_log_loss(dataset(spark, sf_dir))
    return spark.createDataFrame([(error, loss)], "error_rate double, log_loss double").select(rounded("error_rate").alias("error_rate"), rounded("log_loss").alias("log_loss"))


@query("forest_train")
def forest_train(spark, sf_dir):
    """Grown trees draw their thresholds from NumPy's generator: tested by properties."""
    from strataloom.operators.forest import QuantForest

    data = dataset(spark, sf_dir, seed=SEED)
    train, valid = (data.view(df) for df in _splits(data.df))
    forest = QuantForest(num_estimators=8, limit_mb=max(0.01, train.shape[0] * LENGTH * 4 / 2 / (1 << 20)), depth=3).fit(train)
    found = [(name, len(forest.trees), *forest.score_log_loss(d)) for name, d in (("train", train), ("valid", valid))]
    return spark.createDataFrame(found, "split string, trees int, error_rate double, log_loss double")


@query("mllib_baselines")
def mllib_baselines(spark, sf_dir):
    """All five learners with fewer rounds and trees than BASELINES names (README)."""
    from strataloom.operators.baselines import BASELINES, run_baseline

    rows = dataset(spark, sf_dir).flat().persist()
    train, valid = _splits(rows)
    boosted = {"rounds": 2, "max_depth": 2, "patience": 1}
    less = {"tree": {}, "forest": {"trees": 5, "max_depth": 8}}
    found = [(b.name, b.substitute, split, err) for b in BASELINES for split, err in run_baseline(b, train, {"train": train, "valid": valid}, **less.get(b.name, boosted)).items()]
    rows.unpersist()
    return spark.createDataFrame(found, "learner string, substitute string, split string, error_rate double")


@query("measure_names", "select * from (values ('multi_error', 0.25::double, 'merror', 0.25::double), ('Accuracy', 0.75, 'merror', 0.25), ('merror', 0.5, 'merror', 0.5), ('other', 0.125, 'other', 0.125)) t(name, value, measure, normalised)")
def measure_names(spark, sf_dir):
    rows = [(n, v, *metrics.normalised_measure(n, v)) for n, v in (("multi_error", 0.25), ("Accuracy", 0.75), ("merror", 0.5), ("other", 0.125))]
    return spark.createDataFrame(rows, "name string, value double, measure string, normalised double")


@query("streaming_fit", f"with recursive {_training_sql(['true'], 4)} {_LEAVES} ce_1")
def streaming_fit(spark, sf_dir):
    """The online learner over a file stream of the table, until all of it has been read."""
    from strataloom.streaming.online import OnlineTrainer

    rows = embeddings(spark, sf_dir)
    source = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/embeddings.parquet*").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")
    trainer = OnlineTrainer(HashBoost(CLASSES, num_pairs=4, lr=LR, seed=SEED))
    trainer.start(source, shared_folder(spark, "stream")).awaitTermination()
    return leaves_of(trainer.booster, spark)


@query("results_json", f"with {_STAGED_ERROR} select 'hashboost' as model, 'round' as x_name, 'train' as split, 'merror' as metric, {BITS} as bits, round as x, round(error_rate, 6) + 0.0 as y from err")
def results_json(spark, sf_dir):
    """The nested document of a run, written, read and laid out as rows again."""
    points = staged(spark, sf_dir).select(F.lit("hashboost").alias("model"), F.lit("round").alias("x_name"), F.lit("train").alias("split"), F.lit("merror").alias("metric"), F.col("round").alias("x"), F.col("error_rate").alias("y"))
    params = spark.createDataFrame([("hashboost", BITS, LR)], "model string, bits int, lr double").select("model", F.struct("bits", "lr").alias("params"))
    at = write_results(results_document(curve(points, "x", "y", "model", "x_name", "split", "metric"), params, dataset="embeddings", depth=DEPTH, div=DIV), shared_folder(spark, "results"))
    form = "struct<models: map<string, struct<x_name: string, params: struct<bits: int, lr: double>, results: map<string, map<string, struct<x: array<int>, y: array<double>>>>>>>"
    rows = spark.read.text(at, wholetext=True).select(F.from_json("value", form).alias("d"))
    rows = rows.select(F.explode("d.models").alias("model", "m")).select("model", "m.x_name", "m.params.bits", F.explode("m.results").alias("split", "r")).select("*", F.explode("r").alias("metric", "c"))
    rows = rows.select("model", "x_name", "bits", "split", "metric", F.explode(F.arrays_zip("c.x", "c.y")).alias("p"))
    return rows.select("model", "x_name", "split", "metric", "bits", F.col("p.x").alias("x"), rounded("p.y").alias("y"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUANT features, three boosting rounds, error rates by split."""
    rows = featured(spark, sf_dir).persist()
    train, valid = _splits(rows)
    booster = HashBoost(CLASSES, num_pairs=6, seed=SEED)
    for i in range(3):
        booster.fit_batch(train.where(F.pmod(F.floor(shuffle_key("id", SEED) / 1024), F.lit(3)) == i))
    parts = [booster.predict_proba(df).withColumn("split", F.lit(name)) for name, df in (("train", train), ("valid", valid))]
    return metrics.error_rate(parts[0].unionByName(parts[1]).withColumn("prediction", metrics.label_of(F.col("proba"))), "prediction", "label", "split")


