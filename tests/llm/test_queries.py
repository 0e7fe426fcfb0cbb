import re

import duckdb
import pytest

from stockpot.llm.queries import ORACLE_SQL, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, data, name):
    sql = duckdb.connect()
    for t in ("documents", "embeddings"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, found = QUERIES[name](spark, data), sql.sql(ORACLE_SQL[name])
    names, others = df.columns, list(found.columns)
    order = lambda rows, names: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rows), key=repr)
    assert order(df.collect(), names) == order(found.fetchall(), others)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_on_the_tables(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
