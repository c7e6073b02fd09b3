"""Every registered query of the engine that has SQL gives the rows that DuckDB gives for it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from testsieve.plans import catalog
from testsieve.plans.fixtures import TABLES

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=repr)


def test_every_query_without_sql_is_known():
    without = set(QUERIES) - set(ORACLES)
    assert without == {"v05_projection", "m10_evaluate", "c04_eps", "c01_kmeans", "c02_best_k", "c08_ward", "c09_best_cut", "c10_dendrogram", "d01_pca", "d03_random_projection", "d02_tsne"}
