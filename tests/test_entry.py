import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(names)
    return sorted(str([float(v) if isinstance(v, int) else v for v in (dict(zip(names, r))[c] for c in order)]) for r in found)


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == oracle.ORACLE_SQL.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(oracle.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
