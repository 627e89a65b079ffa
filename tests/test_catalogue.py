"""Each query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue

AT = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.6g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(AT):
        c.execute(f"create view {t.split('.')[0]} as select * from '{AT}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = normal(catalogue.queries()[name](spark, AT).toPandas())
    want = normal(con.execute(catalogue.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, AT).count() > 0


def test_communities_of_all_orders(spark):
    """Customers with their orders are stars, so each is one community of all of them."""
    want = {}
    for r in spark.read.parquet(f"{AT}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        want.setdefault(r.o_custkey, {f"c{r.o_custkey}"}).add(f"o{r.o_orderkey}")
    got = {}
    for r in catalogue.queries()["louvain_communities"](spark, AT).collect():
        got.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
