"""Every registered query of the engine against its SQL in DuckDB, on the driver's tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from quarryfield import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    return str(v)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = duck.sql(catalog.ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(df.dtypes) == sorted((c, KINDS[str(t)]) for c, t in zip(rel.columns, rel.types))
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want


def test_flagship_plan_reaches_the_scan(spark):
    plan = catalog.QUERIES[catalog.FLAGSHIP](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan
    assert "ReadSchema" in plan and "ts:" not in plan.split("ReadSchema")[1].split(">")[0]
