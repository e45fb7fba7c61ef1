"""Every registered query against its SQL in DuckDB, on the same files."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

from verifolio import queries  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    answer = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(answer.columns)
    assert rows(df.columns, df.collect()) == rows(answer.columns, answer.fetchall())


def test_every_query_has_sql_but_the_fold():
    assert queries.QUERIES.keys() - queries.SQL.keys() == {"repair_lines_insert"}
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "n_words", "n_missing", "coverage"]


def test_no_cross_products(spark, sf):
    """Joins are on keys; only the closed list of page sizes is compared without one."""
    for name in ("image_neighbours", "overlap_antijoin", "block_look_lookup", "missing_lines", "sheet_rows", "docx_plan"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_columns_are_pruned(spark, sf):
    plan = queries.QUERIES["word_coverage"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
