"""Every query with SQL gives DuckDB's rows on the small tables."""

import duckdb
import pytest

from gridloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "orders part lineitem customer supplier embeddings".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def keyed(values):
    return sorted(values, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    own, other = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    a = keyed(tuple(map(_plain, r)) for r in own[sorted(own.columns)].itertuples(index=False))
    b = keyed(tuple(map(_plain, r)) for r in other[sorted(other.columns)].itertuples(index=False))
    assert len(a) == len(b)
    assert a == b


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, str):
        return v
    return round(float(v), 5) + 0.0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
