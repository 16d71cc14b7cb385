"""Every query with an oracle against DuckDB on the smallest tables; the others give rows of a stable schema."""

import duckdb
import pandas as pd
import pytest

from epochfold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"loso_random_forest", "loso_svm_rbf"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v.tolist() if hasattr(v, "tolist") else v
    return list(df.columns), sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert norm(got) == norm(duck.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
