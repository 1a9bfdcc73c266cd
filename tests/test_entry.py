"""The driver contract: names, schemas, and rows against SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from polyatlas.plans import driver

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def _rows(records):
    plain = lambda v: None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(driver.ORACLES))
def test_query_equals_sql(spark, oracle, name):
    got = driver.QUERIES[name](spark, SF_DIR)
    result = oracle.execute(driver.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.select(*columns).collect()) == _rows(result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark):
    from pyspark.sql import functions as F

    plan = driver.driver_atlas(spark, SF_DIR).query().where("o_orderstatus = 'F'").select(["o_totalprice"]).to_frame().agg(F.count("*"))._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
