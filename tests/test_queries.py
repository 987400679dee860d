"""Every star-schema query against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from impactlake.plans import queries as plans
from impactlake.plans import catalog, composed, evidence, families, output, reports, runs, stores, tables  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if hasattr(x, "year"):
        return str(x)[:10]
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) and x == int(x) else x


def rows(p):
    return sorted(map(repr, p[sorted(p.columns)].astype(object).map(plain).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, con, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_without_oracle(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert plans.flagship(spark, SF).count() > 0
