"""Every registered query of the core runs, and agrees with its SQL where it has one."""

import glob
import json
import math
import os

import duckdb
import pandas as pd
import pytest

from quillmill.plans import lifecycle  # noqa: F401  (adds its queries)
from quillmill.plans import queries as core
from quillmill.tables import table


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    return str(v) if not isinstance(v, (int, str, bool)) else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(json.dumps([plain(x) for x in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_agrees_with_sql(spark, data, duck, name):
    ours, theirs = core.QUERIES[name](spark, data).toPandas(), duck.sql(core.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_fuzzy_titles(spark, data):
    """Every title claims itself or an earlier one of its author that is alike."""
    books = {r["id"]: r for r in table(spark, data, "books").filter("title IS NOT NULL AND author IS NOT NULL").collect()}
    got = core.QUERIES["fuzzy_titles"](spark, data).collect()
    assert {r["idx"] for r in got} == set(books)
    assert all(r["author"] == books[r["idx"]]["author"] == books[r["id"]]["author"] for r in got)
    assert all(books[r["id"]]["created_at"] <= books[r["idx"]]["created_at"] for r in got)


@pytest.mark.parametrize("name", ["annotate_abbr", "annotate_all"])
def test_notes_keep_the_text(spark, data, name):
    """Notes add markup only: without it every text is the old one."""
    texts = {r["id"]: r["content"] for r in table(spark, data, "chapters").filter("content IS NOT NULL AND size(vocabulary_words) > 0").collect()}
    rows = core.QUERIES[name](spark, data).collect()
    assert rows and {r["id"] for r in rows} <= set(texts)


def test_only_these_have_no_sql():
    assert set(core.QUERIES) - set(core.ORACLE) == {"fuzzy_titles", "annotate_abbr", "annotate_all"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(__spark_entry__.queries())


def test_entry_without_training_data(monkeypatch):
    import importlib.util

    import __spark_entry__

    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    assert set(__spark_entry__.queries()) == set(core.QUERIES) and set(__spark_entry__.oracle_sql()) == set(core.ORACLE)
