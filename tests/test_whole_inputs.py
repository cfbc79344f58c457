"""Registered queries over every row of their tables, against their SQL."""

import __spark_entry__ as entry
import duckdb
import pytest


def whole_sql(name, sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con, entry.oracle_sql()[name]


@pytest.mark.parametrize("name", ["s4_plan_intake", "c3_start_end_count", "c4_unknown_node", "c8_model_fanout_unbounded", "c11_principal_decisions", "c12_exposures", "s2_manifest_intake"])
def test_every_order_and_grant(spark, sf, name):
    con, sql = whole_sql(name, sf)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, sf).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    assert got


def test_every_order_is_a_plan(spark, sf):
    """Taken or refused, each order is one row: s4 tells of each plan since it reads damaged ones."""
    rows = entry.queries()["s4_plan_intake"](spark, sf).collect()
    orders = {r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    assert len(rows) == len(orders) and {r.k for r in rows} == orders
    assert all((r.problem is None) == (r.nodes is not None) for r in rows) and len({r.problem for r in rows}) > 30
