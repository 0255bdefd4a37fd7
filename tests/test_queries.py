"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from provenia.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sql, name):
    got = registry.QUERIES[name](spark, SF)
    want = sql.sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    b = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b
