"""Each registered query against its SQL in DuckDB, on the driver's smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from seqlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    rel = con.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(([plain(r[k]) for k in at] for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert registry.QUERIES.keys() <= __spark_entry__.queries().keys() and registry.ORACLE_SQL.keys() <= __spark_entry__.oracle_sql().keys()
