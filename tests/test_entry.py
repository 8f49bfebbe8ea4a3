"""The queries beside their SQL, on the smallest tables where they are present."""

import os

import pytest

import __spark_entry__ as entry
import tools_compare as tc

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CORE = [k for m in entry._MODULES for k in m.QUERIES if k in m.ORACLE]


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in tc.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = tc.rows([c[0] for c in cur.description], cur.fetchall())
    assert tc.rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_flagship(spark):
    assert entry.entry(spark).columns == ["rec_id", "chrom", "chrom_start", "chrom_end"]
