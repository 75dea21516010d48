"""The registered queries with SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quern.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    out = registry.QUERIES[name](spark, SF)
    expected = con.sql(registry.ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(expected.columns)
    got = sorted(str(tuple(r)) for r in out.select(*expected.columns).collect())
    assert got == sorted(str(r) for r in expected.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 14))
