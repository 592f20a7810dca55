"""Every registered query of the nine problems runs on the smallest tables, and agrees with its SQL where it has one."""

import os

import duckdb
import pytest

from millrace.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, DIR)
    rows = [tuple(r) for r in got.select(sorted(got.columns)).collect()]
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(DIR):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
        want = con.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({sql})").fetchall()
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_sql_only_of_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())
