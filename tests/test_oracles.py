"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest
from conftest import SMALL

from skirmish.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else 0.0 if x == 0 and isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_matches_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    want = duck.execute(catalogue.oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracles())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_plans(spark, sf):
    def plan(name):
        return catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    assert "CartesianProduct" not in plan("symmetric_pair_join") and "NestedLoop" not in plan("symmetric_pair_join")
    assert "NestedLoop" not in plan("interval_join")
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan("information_sums")
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan("keyset_page")
