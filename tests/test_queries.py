"""Every query with SQL is compared with DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.neighbourhood.ORACLE_SQL)


@pytest.fixture(scope="module")
def oracle(small):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, oracle, name):
    got, want = entry.queries()[name](spark, small).toPandas(), oracle.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = got.sort_values(sorted(got.columns), kind="stable"), want.sort_values(sorted(want.columns), kind="stable")
    assert len(got) == len(want)
    for c in got.columns:
        a, b = got[c].tolist(), want[c].tolist()
        same = [pd.isna(x) and pd.isna(y) if pd.isna(x) or pd.isna(y) else x == y for x, y in zip(a, b, strict=True)]
        assert all(same), (c, [(x, y) for x, y, s in zip(a, b, same, strict=True) if not s][:3])


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_heavy_plans_stay_jvm_side(spark, small):
    for name in ("buildings", "quadtree_cells", "range_join", "nearest_images", "landmark_accuracy"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan, name
