"""Every query of the core with SQL against DuckDB; the others must run and keep their schema."""

import os

import pytest

import __spark_entry__ as entry
from lexloom.plans import registry
from tests.oracle import check, duck

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    check(spark, DATA, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.collect() is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def with_long_texts(folder):
    """The smallest tables, with items and documents that say what clauses say behind 60,000 characters."""
    con, bodies = duck(DATA), {"parliament_items": "body_text", "documents": "text"}
    said = "repeat('xq ', 20000) || (SELECT string_agg(text, ' ') FROM (SELECT text FROM clauses WHERE length(text) > 300 ORDER BY id LIMIT 3))"
    for name in ("parliament_items", "documents", "clauses", "contracts", "concepts", "clause_concepts"):
        replaced = f"REPLACE ({said} AS {bodies[name]})" if name in bodies else ""
        con.execute(f"COPY (SELECT * {replaced} FROM {name}) TO '{folder}/{name}.parquet'")
    return str(folder)


def test_gate_outcomes_uses_the_whole_of_long_texts(spark, tmp_path):
    folder = with_long_texts(tmp_path)
    check(spark, folder, QUERIES["gate_outcomes"], SQL["gate_outcomes"])
    assert {r["outcome"] for r in QUERIES["gate_outcomes"](spark, folder).collect()} == {"judged", "over_budget"}


def test_ranked_documents_uses_the_whole_of_long_texts(spark, tmp_path):
    folder = with_long_texts(tmp_path)
    check(spark, folder, QUERIES["ranked_documents"], SQL["ranked_documents"])
    assert {r["bm25"] > 20 for r in QUERIES["ranked_documents"](spark, folder).where("rank = 1").collect()} == {True}


def test_texts_of_items_do_not_go_into_the_pairs(spark):
    from lexloom.plans import judging

    assert judging._candidates(spark, DATA).columns == ["item_id", "ref", "text", "own", "legislation_type"]
