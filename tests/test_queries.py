"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from bramble.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in sorted(f.removesuffix(".parquet") for f in os.listdir(SF)):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(columns):
    return sorted(map(repr, zip(*columns, strict=True)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLE_SQL:
        assert got.num_rows == 25
        return
    want = oracle.sql(ORACLE_SQL[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    assert rows(got[c].to_pylist() for c in names) == rows(want[c].to_pylist() for c in names)


def test_plans(spark):
    from bramble.plans.planner import explain

    plan = lambda n: explain(QUERIES[n](spark, SF))
    assert "BroadcastHashJoin" in plan("join_broadcast_find")
    assert "SortMergeJoin" in plan("join_cogroup")
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,10), LessThan(o_orderkey,500)]" in plan("scan_range")
    assert "StringStartsWith(c_name,Cust)" in plan("opt_like_general_prefix")
    assert "WindowGroupLimit" in plan("topk_per_group")
    assert "TakeOrderedAndProject" in plan("order_limit")
    for name in QUERIES:
        if name != "join_cross":
            assert "CartesianProduct" not in plan(name), name


def test_plans_at_scale(spark):
    """Without broadcasts: nothing but what is asked for is paired out, and no window deals rows by a key that may be hot."""
    from bramble.plans.planner import explain

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda n: explain(QUERIES[n](spark, SF))
        for name in QUERIES:
            if name not in ("join_cross", "join_theta", "cte_self_join"):
                assert "CartesianProduct" not in plan(name), name
        for name in ("intersect_all", "except_all", "join_at_most_one", "dml_insert"):
            assert "Window" not in plan(name), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
