"""Every registered query of the core runs, and agrees with its SQL."""

import os

import duckdb
import pytest

from millrace.plans import registry

DIR = os.environ.get("QUERY_DIR", "/root/testdata/sf0.001")
ALL = {**registry.queries(), **registry.whole_queries()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(x):
    return bytes(x).hex() if isinstance(x, (bytes, bytearray)) else x


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, name):
    got = ALL[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(columns).collect()]
    sql = registry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(DIR):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
        want = [tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))
