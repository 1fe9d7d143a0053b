"""Every registered query with an oracle gives DuckDB's rows on the small tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from strataloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, db, name):
    ours, theirs = ordered(catalog.QUERIES[name](spark, SF).toPandas()), ordered(db.sql(catalog.ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs) > 0
    for c in ours.columns:
        if pd.api.types.is_float_dtype(ours[c]):
            assert (ours[c] - theirs[c]).abs().max() < 2e-6
        else:
            assert (ours[c] == theirs[c]).all(), c


@pytest.mark.parametrize("name", ["forest_train", "mllib_baselines"])
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert {r["split"] for r in catalog.flagship(spark, SF).collect()} == {"train", "valid"}


def test_entry_imports_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith(("strataloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "strataloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
