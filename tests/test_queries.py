"""Every registered query against DuckDB on the smallest tables."""

import duckdb
import pytest

from polyzona.plans import record_queries, spatial_queries, table_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = spatial_queries.R.queries | table_queries.R.queries | record_queries.R.queries
SQL = spatial_queries.R.sql | table_queries.R.sql | record_queries.R.sql


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr([repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).toLocalIterator())
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == plain(duck.execute(f"SELECT {names} FROM ({SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
