"""Every query that has SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from braidview import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_equals_sql(name, spark, sf_dir, db):
    a, b = catalogue.QUERIES[name](spark, sf_dir).toPandas(), db.execute(catalogue.SQL[name]).df()
    names = sorted(a.columns)
    assert sorted(b.columns) == names and len(a) == len(b)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
    for c in names:
        if a[c].dtype.kind in "fiu" and b[c].dtype.kind in "fiu":
            assert (((a[c] - b[c]).abs() < 1e-6) | (a[c].isna() & b[c].isna())).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
