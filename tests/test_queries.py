"""Named queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from codexflow.plans import catalog

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        return
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert all(TYPES.get(t, t) == kinds[c] for c, t in df.dtypes)
    table = rel.arrow()
    table = table.read_all() if hasattr(table, "read_all") else table
    assert got == sorted(tuple(plain(r[c]) for c in columns) for r in table.to_pylist())
