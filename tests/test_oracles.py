"""Every registered query with a statement, against DuckDB on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, table

STATEMENTS, QUERIES = oracle_sql(), queries()


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def test_statements_belong_to_queries():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_sql(spark, small, db, name):
    df = QUERIES[name](spark, small)
    result = db.execute(STATEMENTS[name])
    columns = [c[0] for c in result.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 20
