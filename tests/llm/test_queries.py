"""Registered queries against their SQL over whole tables."""

import os

import duckdb
import pytest

from assayline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert a == b
