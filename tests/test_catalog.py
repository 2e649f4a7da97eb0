"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from scorepool.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def ranked(rows):
    clean = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert ranked(frame.select(columns).collect()) == ranked([tuple(r[i] for i in at) for r in want.fetchall()])


def test_grams_are_counted_in_shares(spark, duck, monkeypatch):
    """Tasks grow in number with the text, both those of documents and those of grams, and counts stay whole."""
    size = duck.sql("SELECT sum(strlen(text)) FROM documents").fetchall()[0][0]
    monkeypatch.setattr(catalog, "GRAM_BYTES", size // 40)
    frame = catalog.ngram_counts(spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and frame.rdd.getNumPartitions() >= 40
    assert ranked(frame.select("gram", "n").collect()) == ranked(duck.sql(catalog.SQL["ngram_counts"]).select("gram", "n").fetchall())


def test_flagship(spark):
    rows = {r["method"]: r for r in entry.entry(spark).collect()}
    assert set(rows) == {"direct", "best_of_4"} and rows["best_of_4"]["ok"] >= rows["direct"]["ok"]


def test_bootstrap_is_reproducible(spark):
    a, b = (sorted(map(tuple, catalog.cluster_bootstrap_ci(spark, SF).collect()), key=str) for _ in range(2))
    assert a == b and all(r[3] is None or r[3] <= r[4] for r in a)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_catalog_stands_without_the_corpus_operators(monkeypatch):
    real = entry.find_spec
    for absent in ("corpus_pipeline", "scorepool.llm", "scorepool.llm.queries"):
        monkeypatch.setattr(entry, "find_spec", lambda name, absent=absent: None if name == absent else real(name))
        assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.SQL)
