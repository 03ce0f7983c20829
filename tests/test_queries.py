"""Every core query against its SQL on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rangeparts import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, found):
    def plain(v):
        if isinstance(v, dt.datetime):
            return v.isoformat(" ")
        return v.isoformat() if isinstance(v, dt.date) else round(v, 6) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = tables.execute(queries.ORACLE_SQL[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(df.columns, df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_routing_does_not_nest_loops(spark):
    plan = queries.QUERIES["route_rows"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = queries.QUERIES["floor_monthly"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan
