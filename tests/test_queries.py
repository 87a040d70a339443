"""Registered queries against their SQL on the smallest tables, where they are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = ("knn_cosine", "range_l2", "latest_patch", "section_ids", "incremental_outcomes", "docsets_nested", "document_aliases", "lexemes_simple", "p7_found", "p7_replay", "p5_iso_epoch", "chunk_documents", "half_arithmetic", "half_aggregates", "sparse_overloads", "knn_with_ties", "vec_round_trips")


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
    assert all(s.lstrip().upper().startswith(("WITH", "SELECT")) for s in sql.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    rel = con.sql(entry.oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(rel.columns) == order
    text = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    have = sorted(tuple(text(r[c]) for c in order) for r in got.collect())
    want = sorted(tuple(text(v) for v in r) for r in con.sql(f"SELECT {', '.join(order)} FROM rel").fetchall())
    assert have == want
