"""The corpus queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from epochfold.llm import queries
from tests.test_oracles import SF, TABLES, norm


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    assert len(got) and norm(got) == norm(con.sql(queries.oracle_sql()[name]).df())
