"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from stockpot.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    rows, names = [tuple(r) for r in df.collect()], df.columns
    if name not in ORACLE_SQL:
        assert rows
        return
    found = sql.sql(ORACLE_SQL[name])
    assert sorted(names) == sorted(found.columns)
    order = lambda rows, names: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rows), key=repr)
    assert order(rows, names) == order(found.fetchall(), list(found.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
