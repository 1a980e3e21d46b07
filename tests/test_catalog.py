import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from logloom import catalog


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_its_sql(spark, small, db, name):
    df = catalog.QUERIES[name](spark, small)
    answer = db.execute(catalog.SQL[name])
    want = rows_of([c[0] for c in answer.description], answer.fetchall())
    assert rows_of(df.columns, df.collect()) == want


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"model_report", "model_importance"}
