"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    pd.testing.assert_frame_equal(plain(catalog.QUERIES[name](spark, SF).toPandas()), plain(db.sql(catalog.ORACLE_SQL[name]).df()))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "chunk_id", "place", "n_chars"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
