"""The queries for training data beside their SQL, on the smallest tables where they are present."""

import os

import duckdb
import pytest

from helixframe.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in ("narrowpeak", "documents", "mix_targets", "pack_capacity"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(queries.ORACLE[name])
        assert [c[0] for c in cur.description] == df.columns and sorted(cur.fetchall(), key=repr) == got
