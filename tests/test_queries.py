"""Every record query against DuckDB, and the driver's contract."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from ledgerloom.plans.registry import NAMES, ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda v: "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLE_SQL])
def test_same_rows(spark, small, duck, name):
    got, want = entry.queries()[name](spark, small).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ORACLE_SQL])
def test_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id", "email", "website", "flag"] and out.count() == 200


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
