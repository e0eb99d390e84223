"""Every registered query with SQL against that SQL, on the smallest tables."""

import importlib
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return "nan" if math.isnan(x) else repr(round(float(x), 6) + 0.0)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    right = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(right.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(right.fetchall(), right.columns)


WITHOUT_SQL = sorted(k for plan in entry.PLANS for k in plan.QUERIES if k not in SQL)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_queries_without_sql_run(spark, name):
    df = entry.queries()[name](spark, SF)
    found = df.collect()
    assert found and len(set(df.columns)) == len(df.columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_pipeline_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "splicespark"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
    assert importlib.import_module("splicespark.plans.build").QUERIES
