"""Queries against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from touchline.plans.oracles import ORACLES
from touchline.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()
HEAVY = {"selection", "selected_heatmap", "selected_null", "status_by_family", "selection_summary", "null_markers", "catalogue_surface"}  # as monte_carlo_pvalue, once more


def rows(df):
    def cell(v):
        if v is None or v != v:
            return "~"
        return str(v) if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else repr(float(v))

    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(db.execute(ORACLES[name]).fetchdf())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "p" in df.columns
