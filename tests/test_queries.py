"""Every query of the library against its SQL on the driver's tables."""

import duckdb
import pytest

from gridsmith.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def compared(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    x, y = (f[columns].sort_values(columns).reset_index(drop=True) for f in (a, b))
    assert len(x) == len(y)
    for c in columns:
        assert ((x[c] == y[c]) | (x[c].isna() & y[c].isna())).all(), (c, x[c].head().tolist(), y[c].head().tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_its_sql_rows(spark, duck, sf_dir, name):
    compared(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


def test_kmeans_folds_deal_all_patches(spark, sf_dir):
    rows = QUERIES["kmeans_folds"](spark, sf_dir).collect()
    assert len(rows) == 5 and sum(r.n for r in rows) == 500 and min(r.n for r in rows) > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["scene_filter_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(value,20.0)" in plan and "props" not in plan
