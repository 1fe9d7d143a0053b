"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from strataloom.llm import registry
from strataloom.llm.common import drop_made, made_here, partitions_for, saved

LONG = "lorem ipsum dolor sit amet " * 4000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, id long, fp long, bucket int"
ROWS = [
    (1, None, "en", "s"), (2, "", "en", None), (3, "hello wide world", None, "s"), (3, "hello wide world", None, "s"), (None, "hello wide world", "de", "s"), (None, None, None, None),
    (4, LONG, "en", "t"), (5, LONG, "en", "t"), (6, "one two three four five six seven eight", "fr", "u"), (7, "   \n\t ", "fr", "u"),
]
NAMES = [*registry.QUERIES, "pipeline"]


def write(spark, folder, docs, vectors, labels, items):
    spark.createDataFrame([(*r, 0, 0.5, 9, 9, 9, 9) for r in docs], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, vector int, leaf int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string, size int, h int").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    nan = float("nan")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (100, [0.5, 0.5]), (100, [0.5, 0.5]), (7, [1.0])]
    items = [(0, "one two three four five six seven eight"), (1, None), (2, ""), (3, "hello wide world"), (None, "x"), (0, "one two three four five six seven eight")]
    return write(spark, tmp_path_factory.mktemp("edges"), ROWS, [(*v, 0, 0, 0) for v in vectors], [(1, 0, 1, "x"), (3, None, 0, None), (4, 1, None, "y"), (None, 1, 1, "z")], [(*i, 0, 0) for i in items])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


def run(spark, name, folder):
    return (corpus_pipeline.run if name == "pipeline" else registry.QUERIES[name])(spark, folder).collect()


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert run(spark, name, empty) == []


@pytest.mark.parametrize("name", [n for n in NAMES if n[:4] in ("op2_", "op3_", "op6_", "op7_", "op8_", "op9_", "op10")])
def test_one_row_for_each_document(spark, edges, name):
    rows = run(spark, name, edges)
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 1, 2, 3, 3, 4, 5, 6, 7]


def test_vectors_that_take_no_part(spark, edges):
    rows = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in run(spark, "op1_ann", edges)}
    near = 0.5**0.5
    assert rows == {(0, 1): (1, 0.0), (0, 2): (100, near), (100, 1): (0, near), (100, 2): (1, near)}


def test_matches_of_odd_items(spark, edges):
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in run(spark, "op4_decontamination", edges)} == {(3, 3, 1.0), (None, 3, 1.0), (6, 0, 1.0)}


def test_copies_of_long_texts(spark, edges):
    rows = {r["doc_id"]: r for r in run(spark, "op6_suffixes", edges)}
    assert rows[5]["n_removed"] == rows[5]["n_bytes"] == len(LONG) and rows[5]["n_spans"] == 1 and rows[4]["n_removed"] == 0
    linked = {r["doc_id"]: r["component_id"] for r in run(spark, "op7_simhash", edges)}
    assert linked[5] == 4 and linked[None] in (1, 3) and linked[7] == linked[2] == 1


def test_mixture_of_odd_rows(spark, edges):
    rows = run(spark, "op5_mixing", edges)
    assert all(0 <= r["taken"] <= r["n_tokens"] for r in rows) and {r["lang"] for r in rows} >= {"", "en", "fr"}


def test_stages_keep_columns(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, edges), "test-stage")
        last = name == corpus_pipeline.STAGES[-1][0]
        assert out.columns == docs.columns if not last else set(out.columns) == {*docs.columns, "slot"}
        if name == "near_dedup":
            assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 6]  # 1, 2, 7 and the null row are all empty
        docs = out
    assert docs.count() > 0


def test_pipeline_leaves_its_rows_only(spark, edges):
    before = made_here()
    assert corpus_pipeline.run(spark, edges).count() > 0
    new = [at for at in made_here() if at not in before]
    assert len(new) == 1 and "pipeline-sharding" in new[0]
    files = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(new[0]), spark._jsc.hadoopConfiguration())
    assert files.exists(spark._jvm.org.apache.hadoop.fs.Path(new[0]))
    drop_made(spark, new)
    assert not files.exists(spark._jvm.org.apache.hadoop.fs.Path(new[0])) and made_here() == before


def test_sizes_that_arent_known_give_the_sessions_partitions(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    assert partitions_for(docs, 1 << 30) == 4 and partitions_for(docs, 100) > 4
    assert partitions_for(spark.createDataFrame(docs.rdd, docs.schema), 1 << 20) == 4
