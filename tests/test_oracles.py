"""Each query against its SQL in DuckDB: names, types, rows."""

import duckdb
import pyarrow.parquet as pq
import pytest

from wavecrest.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, pq.read_table(f"{sf_dir}/{t}.parquet"))
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes if k in TYPES} == {c: kinds[c] for c, k in df.dtypes if k in TYPES}
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
