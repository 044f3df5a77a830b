import math

import duckdb
import pytest

import __spark_entry__
from loomlint import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_spark_and_sql_agree(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert df.limit(1).count() == 1  # agreement on no rows says nothing
    assert sorted(tuple(map(norm, r)) for r in df.select(*cols).collect()) == sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_run(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_the_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_prune_and_push_down(spark, sf):
    plan = catalog.QUERIES["vocabulary_member"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.0)" in plan
    assert "c_name" not in plan
