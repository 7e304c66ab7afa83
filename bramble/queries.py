"""One query for each operator, over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types as T
from .catalog import Aggregate, Column, Default, Function, Index, Sequence, Table, Variable
from .functions import scalar as X
from .functions.registry import add_aggregate, add_function, call, table_function
from .operators import exchange
from .operators import subquery as Q
from .operators.index_joins import join_find, join_scan
from .operators.relation import Bound, Relation, agg
from .plans import dml
from .plans.planner import Term, filter_with_range_hint
from .session import Session
from .sources.tables import find, scan, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Relations over a folder of Parquet tables, in one session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.dir, self.session = sf_dir, Session(spark)
        self.spark = self.session.spark
        self.catalog, self.schema = self.session.catalog, self.session.catalog.schemas.find("public")

    def __getattr__(self, name: str) -> Relation:
        return Relation(self.spark.read.parquet(f"{self.dir}/{name}.parquet"), None, self.session.gates, self.catalog)


def query(sql: str | None = None):
    """Register a query under its function's name. The function takes Tables."""

    def register(build: Callable[[Tables], Relation | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = build(Tables(spark, sf_dir))
            return made.emit() if isinstance(made, Relation) else made

        run.__name__ = build.__name__
        QUERIES[build.__name__] = run
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1997-06-01' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def revenue_per_nation(t):
    o = t.orders.filter(lambda r: (r["o_orderdate"] >= datetime.datetime(1995, 6, 1)) & (r["o_orderdate"] < datetime.datetime(1997, 6, 1))).select("o_orderkey", "o_custkey")
    buyers = o.join(t.customer.select("c_custkey", "c_nationkey"), on=[("o_custkey", "c_custkey")]).select("o_orderkey", "c_nationkey")
    rows = buyers.join(t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount"), on=[("o_orderkey", "l_orderkey")])
    sums = rows.project(v=lambda r: r["l_extendedprice"] * (X.literal(1) - r["l_discount"])).aggregate(["c_nationkey"], s=agg("sum", lambda r: r["v"]))
    named = sums.join(t.nation, on=[("c_nationkey", "n_nationkey")]).aggregate(["n_name"], s2=agg("sum", lambda r: r["s"]))
    return Relation(named.df.select("n_name", F.round("s2", 2).alias("revenue"))).limit(10, sort=[("revenue", "desc"), "n_name"])


# 2.1 sources


@query("SELECT * FROM nation")
def scan_full(t):
    return scan(t.nation)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 500")
def scan_range(t):
    return scan(t.orders, ["o_orderkey", "o_totalprice"], Bound("inclusive", (("o_orderkey", 10),)), Bound("exclusive", (("o_orderkey", 500),)))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber >= 2 AND l_linenumber <= 5")
def scan_prefixed_range(t):
    return scan(t.lineitem, ["l_orderkey", "l_linenumber", "l_quantity"], Bound("prefixed_inclusive", (("l_orderkey", 7), ("l_linenumber", 2))), Bound("prefixed_inclusive", (("l_orderkey", 7), ("l_linenumber", 5))))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20")
def scan_limit(t):
    return scan(t.orders, ["o_orderkey", "o_custkey"], limit=20, sort=["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def find_point(t):
    return find(t.customer, {"c_custkey": 42}, ["c_custkey", "c_name"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 5 AND l_linenumber = 1")
def find_composite(t):
    return find(t.lineitem, {"l_orderkey": 5, "l_linenumber": 1}, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("SELECT * FROM (VALUES (1, 'one', TRUE), (2, 'two', FALSE), (3, 'three', NULL)) v(id, name, flag)")
def values_literal(t):
    return values(t.spark, ["id", "name", "flag"], [[1, "one", True], [2, "two", False], [3, "three", None]])


@query("SELECT CAST(x AS DECIMAL(38,2)) AS x, y FROM (VALUES (1.00, 'a'), (2.50, NULL), (NULL, 'c')) v(x, y)")
def values_unify(t):
    import decimal

    return values(t.spark, ["x", "y"], [[1, "a"], [decimal.Decimal("2.50"), None], [None, "c"]])


@query("SELECT 1 AS k, (SELECT max(p_size) FROM part) AS v UNION ALL SELECT 2, -1 UNION ALL SELECT 3, (SELECT p_size FROM part WHERE p_partkey = -1)")
def values_subquery(t):
    top = t.part.aggregate(m=agg("max", lambda r: r["p_size"]))
    none = find(t.part, {"p_partkey": -1}, ["p_size"])
    return values(t.spark, ["k", "v"], [[1, top], [2, -1], [3, none]])


@query()
def identify_rowid(t):
    return t.nation.identify("row_id")


@query("SELECT 'min' AS what, min(o_totalprice) AS v FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders")
def buffer_tee(t):
    a, b = t.orders.buffer(2)
    low = a.aggregate(v=agg("min", lambda r: r["o_totalprice"])).project(what="min").select("what", "v")
    high = b.aggregate(v=agg("max", lambda r: r["o_totalprice"])).project(what="max").select("what", "v")
    return low.union(high)


@query("WITH q AS (SELECT n_nationkey, n_name, n_regionkey FROM nation) SELECT a.n_name AS left_name, b.n_name AS right_name FROM q a JOIN q b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def cte_self_join(t):
    a = t.nation.subquery(ka="n_nationkey", left_name="n_name", ra="n_regionkey")
    b = t.nation.subquery(kb="n_nationkey", right_name="n_name", rb="n_regionkey")
    return a.join(b, on=[("ra", "rb")], condition=lambda r: r["ka"] < r["kb"]).select("left_name", "right_name")


@query("SELECT r_regionkey AS key, r_name AS name FROM region")
def escape_rename(t):
    return t.region.escape(key="r_regionkey", name="r_name")


# 2.3 projection and filter


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS a, l_quantity * 2 + 1 AS b FROM lineitem")
def project_chain(t):
    return t.lineitem.project(a=lambda r: r["l_quantity"] * 2, b=lambda r: r["a"] + 1).select("l_orderkey", "l_linenumber", "a", "b")


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 150000 AND o_orderstatus = 'F') OR NOT (o_orderpriority <> '1-URGENT' OR nullif(o_orderstatus, 'O') IS NULL)")
def filter_and_or(t):
    o = t.orders.project(s=lambda r: X.Expr(T.character(), F.nullif(r["o_orderstatus"].column, F.lit("O"))))
    return o.filter(lambda r: (r["o_totalprice"] > 150000) & (r["o_orderstatus"] == "F") | ~((r["o_orderpriority"] != "1-URGENT") | X.is_null(r["s"]))).select("o_orderkey")


@query("SELECT n_name FROM nation WHERE NULL")
def filter_null_condition(t):
    return t.nation.filter(None).select("n_name")


def _series(t) -> None:
    add_function(t.schema, table_function("series", (T.INT8,), {"x0": T.INT8, "x1": T.INT8}, lambda n: F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.struct(i.alias("x0"), (i * i).alias("x1")))))


@query("SELECT l_orderkey, l_linenumber, i * i AS square FROM (SELECT l_orderkey, l_linenumber, unnest(range(1, l_linenumber + 1)) AS i FROM lineitem)")
def apply_tvf(t):
    _series(t)
    rows = t.lineitem.select("l_orderkey", "l_linenumber")
    return rows.apply("series", [lambda r: X.cast(r["l_linenumber"], T.INT8)], {1: "square"})


@query("SELECT n_nationkey, i AS x FROM (SELECT n_nationkey, unnest(range(1, n_regionkey + 2)) AS i FROM nation) WHERE i >= 2")
def apply_tvf_filter(t):
    _series(t)
    rows = t.nation.select("n_nationkey", "n_regionkey").apply("series", [lambda r: X.cast(r["n_regionkey"] + 1, T.INT8)], ["x"])
    return rows.filter(lambda r: r["x"] >= 2).select("n_nationkey", "x")


# 2.4 joins


def _customers(t):
    return t.customer.select("c_custkey", "c_name", "c_nationkey")


def _big_orders(t):
    return t.orders.filter(lambda r: r["o_totalprice"] > 250000).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(t):
    return _customers(t).join(t.orders.select("o_orderkey", "o_custkey"), on=[("c_custkey", "o_custkey")]).select("c_name", "o_orderkey")


@query("SELECT n_name, r_name FROM nation, region")
def join_cross(t):
    return t.nation.select("n_name").join(t.region.select("r_name"))


@query("SELECT a.n_name AS x, r_name AS y FROM nation a JOIN region ON n_regionkey > r_regionkey")
def join_theta(t):
    return t.nation.join(t.region, lower=[("n_regionkey", ">", "r_regionkey")]).escape(x="n_name", y="r_name")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice >= s_acctbal - 5 AND p_retailprice < s_acctbal + 5")
def join_range(t):
    s = t.supplier.project(lo=lambda r: r["s_acctbal"] - 5, hi=lambda r: r["s_acctbal"] + 5).select("s_suppkey", "lo", "hi")
    return s.join(t.part.select("p_partkey", "p_retailprice"), lower=[("lo", "<=", "p_retailprice"), ("hi", ">", "p_retailprice")]).select("s_suppkey", "p_partkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey")
def join_left(t):
    return _customers(t).join(_big_orders(t), "left_outer", [("c_custkey", "o_custkey")]).select("c_custkey", "o_orderkey")


@query("SELECT a.c_custkey, b.o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 10) a FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) b ON c_custkey = o_custkey")
def join_full(t):
    return _customers(t).filter(lambda r: r["c_nationkey"] < 10).join(_big_orders(t), "full_outer", [("c_custkey", "o_custkey")]).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_semi(t):
    return _customers(t).join(_big_orders(t), "semi", [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_anti(t):
    return _customers(t).join(_big_orders(t), "anti", [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1")
def join_at_most_one(t):
    r = t.region.filter(lambda x: x["r_regionkey"] > 1)
    return t.nation.join(r, "left_outer_at_most_one", [("n_regionkey", "r_regionkey")]).select("n_name", "r_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_cogroup(t):
    return t.orders.select("o_orderkey", "o_custkey").join(_customers(t), on=[("o_custkey", "c_custkey")], strategy="merge").select("o_orderkey", "c_name")


@query("SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast_find(t):
    return _customers(t).join(t.nation, on=[("c_nationkey", "n_nationkey")], strategy="broadcast").select("c_name", "n_name")


@query("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey >= n_nationkey AND c_nationkey < n_nationkey + 3")
def join_broadcast_scan(t):
    n = t.nation.project(hi=lambda r: r["n_nationkey"] + 3).select("n_nationkey", "hi")
    return _customers(t).join(n, lower=[("c_nationkey", ">=", "n_nationkey"), ("c_nationkey", "<", "hi")], strategy="broadcast").select("c_custkey", "n_nationkey")


# 2.5 aggregation


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1, 2")
def agg_group(t):
    rows = t.lineitem.project(q=lambda r: X.cast(r["l_quantity"], T.INT8))
    return rows.aggregate(["l_returnflag", "l_linestatus"], n=agg("count"), qty=agg("sum", lambda r: r["q"]), first_ship=agg("min", lambda r: r["l_shipdate"]))


@query("SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE FALSE")
def agg_global_empty(t):
    return t.orders.filter(False).aggregate(n=agg("count"), top=agg("max", lambda r: r["o_totalprice"]))


@query("SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def agg_incremental(t):
    out = t.orders.aggregate(["o_custkey"], n=agg("count"), mean=agg("avg", lambda r: r["o_totalprice"]))
    return out.df.withColumn("mean", F.round("mean", 2))


@query("SELECT l_linenumber, median(l_quantity) AS mid FROM lineitem GROUP BY 1")
def agg_udaf(t):
    add_aggregate(t.schema, Aggregate("middle", (T.FLOAT8,), T.FLOAT8, F.median, incremental=False))
    return t.lineitem.aggregate(["l_linenumber"], mid=agg("middle", lambda r: r["l_quantity"]))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1")
def agg_distinct_fn(t):
    return t.lineitem.aggregate(["l_returnflag"], suppliers=agg("count$distinct", lambda r: r["l_suppkey"]), lines=agg("sum$distinct", lambda r: r["l_linenumber"]))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_all(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT DISTINCT c_nationkey FROM customer")
def distinct_keys(t):
    return _customers(t).distinct("c_nationkey").select("c_nationkey")


# 2.6 order and limit


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit(t):
    return t.orders.select("o_orderkey", "o_totalprice").limit(25, sort=[("o_totalprice", "desc"), "o_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topk_per_group(t):
    return t.orders.limit(3, ["o_custkey"], [("o_totalprice", "desc"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT n_name FROM nation ORDER BY n_name DESC")
def order_full(t):
    return t.nation.select("n_name").limit(None, sort=[("n_name", "desc")])


# 2.7 set operations


def _nations(t):
    c = t.customer.filter(lambda r: r["c_nationkey"] < 15).escape(k="c_nationkey")
    s = t.supplier.filter(lambda r: r["s_nationkey"] > 5).escape(k="s_nationkey")
    return c, s


_CS = ("SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15", "SELECT s_nationkey FROM supplier WHERE s_nationkey > 5")


@query(f"{_CS[0]} UNION ALL {_CS[1]}")
def union_all(t):
    a, b = _nations(t)
    return a.union(b)


@query("SELECT n_nationkey AS k, n_name AS a, NULL::VARCHAR AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def union_outer(t):
    return t.nation.union(t.region, [("n_nationkey", "r_regionkey", "k"), ("n_name", None, "a"), (None, "r_name", "b")])


@query(f"{_CS[0]} UNION {_CS[1]}")
def union_distinct(t):
    a, b = _nations(t)
    return a.union(b, distinct=True)


@query(f"{_CS[0]} INTERSECT ALL {_CS[1]}")
def intersect_all(t):
    a, b = _nations(t)
    return a.intersection(b, distinct=False)


@query(f"{_CS[0]} INTERSECT {_CS[1]}")
def intersect_distinct(t):
    a, b = _nations(t)
    return a.intersection(b)


@query(f"{_CS[0]} EXCEPT ALL {_CS[1]}")
def except_all(t):
    a, b = _nations(t)
    return a.difference(b, distinct=False)


@query(f"{_CS[0]} EXCEPT {_CS[1]}")
def except_distinct(t):
    a, b = _nations(t)
    return a.difference(b)


@query("SELECT c_nationkey FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def intersect_keys(t):
    return _customers(t).intersection(t.supplier, [("c_nationkey", "s_nationkey")]).select("c_nationkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 5)")
def except_keys(t):
    s = t.supplier.filter(lambda r: r["s_nationkey"] > 5)
    return t.nation.difference(s, [("n_nationkey", "s_nationkey")]).select("n_nationkey", "n_name")


# 2.8 subqueries


@query("SELECT n_name, (SELECT max(r_name) FROM region) AS top FROM nation")
def subq_scalar(t):
    return Q.with_scalar(t.nation, "top", t.region.aggregate(m=agg("max", lambda r: r["r_name"]))).select("n_name", "top")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def subq_scalar_filter(t):
    return Q.scalar_filter(t.orders, ">", lambda r: r["o_totalprice"], t.orders.aggregate(m=agg("avg", lambda r: r["o_totalprice"]))).select("o_orderkey")


@query("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def subq_exists(t):
    return Q.exists(t.nation, t.supplier, lambda r: r["n_nationkey"] == r["s_nationkey"]).select("n_name")


@query("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def subq_not_exists(t):
    return Q.exists(t.nation, t.supplier, lambda r: (r["n_nationkey"] == r["s_nationkey"]) & (r["s_acctbal"] > 5000), negated=True).select("n_name")


@query("SELECT n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS supplied FROM nation")
def subq_exists_value(t):
    return Q.with_exists(t.nation, "supplied", t.supplier, [("n_nationkey", "s_nationkey")]).select("n_name", "supplied")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def subq_in(t):
    return Q.in_(t.part, lambda r: r["p_partkey"], t.lineitem.filter(lambda r: r["l_quantity"] > 49).select("l_partkey")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def subq_not_in(t):
    s = t.supplier.filter(lambda r: r["s_acctbal"] > 5000).select("s_nationkey")
    return Q.in_(t.customer, lambda r: r["c_nationkey"], s, negated=True, strict=False).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5)")
def subq_any_lt(t):
    return Q.quantified(t.customer, "<", "ANY", lambda r: r["c_acctbal"], t.supplier.filter(lambda r: r["s_nationkey"] < 5).select("s_acctbal")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal <= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5))")
def subq_not_all(t):
    return Q.quantified(t.customer, "<=", "ALL", lambda r: r["c_acctbal"], t.supplier.filter(lambda r: r["s_nationkey"] < 5).select("s_acctbal"), negated=True).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5)")
def subq_all_gt(t):
    return Q.quantified(t.customer, ">", "ALL", lambda r: r["c_acctbal"], t.supplier.filter(lambda r: r["s_nationkey"] < 5).select("s_acctbal"), strict=False).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders))")
def subq_nested(t):
    mean = t.orders.aggregate(m=agg("avg", lambda r: r["o_totalprice"])).project(m=lambda r: r["m"] * 2)
    return Q.in_(t.customer, lambda r: r["c_custkey"], Q.scalar_filter(t.orders, ">", lambda r: r["o_totalprice"], mean).select("o_custkey")).select("c_custkey")


# 2.9 scalar expressions


@query("SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 7 AS b, o_orderkey * 3 AS c FROM orders")
def expr_arith_int(t):
    return t.orders.project(a=lambda r: r["o_orderkey"] + 1, b=lambda r: r["o_orderkey"] - 7, c=lambda r: r["o_orderkey"] * 3).select("o_orderkey", "a", "b", "c")


@query("""SELECT l_orderkey, l_linenumber, CAST(p + d AS DECIMAL(38,2)) AS a, CAST(p - d AS DECIMAL(38,2)) AS b, CAST(p * d AS DECIMAL(17,4)) AS c
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d FROM lineitem)""")
def expr_arith_decimal(t):
    rows = t.lineitem.project(p=lambda r: X.cast(r["l_extendedprice"], T.decimal(12, 2)), d=lambda r: X.cast(r["l_discount"], T.decimal(4, 2)))
    return rows.project(a=lambda r: r["p"] + r["d"], b=lambda r: r["p"] - r["d"], c=lambda r: r["p"] * r["d"]).select("l_orderkey", "l_linenumber", "a", "b", "c")


@query("SELECT o_orderkey, (o_orderkey - 500) // 7 AS q FROM orders")
def expr_div_int(t):
    return t.orders.project(q=lambda r: (r["o_orderkey"] - 500) / 7).select("o_orderkey", "q")


@query("SELECT o_orderkey, (o_orderkey - 500) % 7 AS m FROM orders")
def expr_mod(t):
    return t.orders.project(m=lambda r: (r["o_orderkey"] - 500) % 7).select("o_orderkey", "m")


@query("SELECT o_orderkey, -o_totalprice AS n, +o_totalprice AS p FROM orders")
def expr_neg(t):
    return t.orders.project(n=lambda r: -r["o_totalprice"], p=lambda r: +r["o_totalprice"]).select("o_orderkey", "n", "p")


@query("SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n FROM part")
def expr_length(t):
    return t.part.project(n=lambda r: X.length(r["p_name"])).select("p_partkey", "n")


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS s FROM customer")
def expr_concat(t):
    return t.customer.project(s=lambda r: X.concat(X.concat(r["c_name"], "/"), r["c_mktsegment"])).select("c_custkey", "s")


@query("SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
def expr_compare(t):
    ops = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    return t.part.project(**{n: (lambda r, o=o: X.compare(o, r["p_size"], 10)) for n, o in ops.items()}).select("p_partkey", *ops)


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%1_'")
def expr_like(t):
    return t.part.filter(lambda r: X.like(r["p_name"], "%1_")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_name || '_%' LIKE 'C%1!_!%' ESCAPE '!'")
def expr_like_escape(t):
    return t.customer.filter(lambda r: X.like(X.concat(r["c_name"], "_%"), "C%1!_!%", "!")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'")
def expr_like_prefix(t):
    return t.orders.filter(lambda r: X.like(r["o_orderpriority"], "1%")).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size FROM orders")
def expr_case(t):
    return t.orders.project(size=lambda r: X.conditional((r["o_totalprice"] > 200000, "big"), (r["o_totalprice"] > 50000, "middle"), default="small")).select("o_orderkey", "size")


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s FROM orders")
def expr_coalesce(t):
    return t.orders.project(s=lambda r: X.coalesce(X.Expr(T.character(), F.nullif(r["o_orderstatus"].column, F.lit("F"))), "none")).select("o_orderkey", "s")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS INTEGER) AS i, CAST(o_orderdate AS DATE) AS d FROM orders")
def expr_cast(t):
    return t.orders.project(s=lambda r: X.cast(r["o_orderkey"], T.character()), i=lambda r: X.cast(r["s"], T.INT4), d=lambda r: X.cast(r["o_orderdate"], T.DATE)).select("o_orderkey", "s", "i", "d")


@query("SELECT o_orderkey, b IS TRUE AS t, b IS FALSE AS f, b IS NULL AS u, nullif(o_orderstatus, 'F') IS NULL AS n FROM (SELECT *, nullif(o_orderstatus, 'F') = 'O' AS b FROM orders)")
def expr_is_true_false_unknown(t):
    o = t.orders.project(s=lambda r: X.Expr(T.character(), F.nullif(r["o_orderstatus"].column, F.lit("F"))), b=lambda r: r["s"] == "O")
    return o.project(t=lambda r: X.is_true(r["b"]), f=lambda r: X.is_false(r["b"]), u=lambda r: X.is_unknown(r["b"]), n=lambda r: X.is_null(r["s"])).select("o_orderkey", "t", "f", "u", "n")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def expr_between_let(t):
    return t.part.filter(lambda r: X.between(r["p_size"], 10, 20)).select("p_partkey")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 25 HOUR AS DATE) AS d, o_orderdate - INTERVAL 36 HOUR AS ts FROM orders")
def expr_date_interval(t):
    return t.orders.project(d=lambda r: X.cast(r["o_orderdate"], T.DATE) + X.interval(hours=25), ts=lambda r: r["o_orderdate"] - X.interval(hours=36)).select("o_orderkey", "d", "ts")


@query("SELECT l_orderkey, l_linenumber, l_shipdate + INTERVAL 1 HOUR * l_linenumber AS ts FROM lineitem")
def expr_interval_scale(t):
    return t.lineitem.project(ts=lambda r: r["l_shipdate"] + X.multiply(X.interval(hours=1), r["l_linenumber"])).select("l_orderkey", "l_linenumber", "ts")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 17")
def expr_host_param(t):
    t.schema.variables.add("customer", Variable("customer", T.INT8, 17))
    return t.orders.filter(lambda r: r["o_custkey"] == t.session.variable("customer")).select("o_orderkey")


@query("SELECT c_custkey, upper(c_name) AS u FROM customer")
def expr_func_call(t):
    add_function(t.schema, Function("shout", (T.character(),), T.character(), F.upper))
    return t.customer.project(u=lambda r: call(t.catalog, "shout", r["c_name"])).select("c_custkey", "u")


# 2.2 data changes


_EXTRA = "(VALUES (3, 'ATLANTIS', 1), (100, 'LEMURIA', 2)) v(n_nationkey, n_name, n_regionkey)"


def _extra(t):
    return values(t.spark, ["n_nationkey", "n_name", "n_regionkey"], [[3, "ATLANTIS", 1], [100, "LEMURIA", 2]])


def _nation(t, *primary):
    t.session.register("nation", t.nation.df, primary=primary)
    return t.session


@query("SELECT * FROM nation UNION ALL SELECT 100, 'LEMURIA', 2")
def dml_insert(t):
    return _nation(t, "n_nationkey").write("nation", _extra(t).filter(lambda r: r["n_nationkey"] > 50), "insert")


@query(f"SELECT * FROM nation UNION ALL SELECT * FROM {_EXTRA} WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def dml_insert_skip(t):
    return _nation(t, "n_nationkey").write("nation", _extra(t), "insert_skip")


@query(f"SELECT * FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT * FROM {_EXTRA}")
def dml_insert_overwrite(t):
    return _nation(t, "n_nationkey").write("nation", _extra(t), "insert_overwrite")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name || '*' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update(t):
    s = _nation(t, "n_nationkey")
    rows = s.table("nation").filter(lambda r: r["n_regionkey"] == 2).project(n_name=lambda r: X.concat(r["n_name"], "*"))
    return s.write("nation", rows, "update", {"n_nationkey": "n_nationkey", "n_name": "n_name"})


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 5 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation")
def dml_update_where(t):
    return dml.update_where(t.nation, lambda r: r["n_nationkey"] < 5, n_regionkey=lambda r: r["n_regionkey"] + 10)


@query("SELECT * FROM nation WHERE n_regionkey <> 2")
def dml_delete(t):
    s = _nation(t, "n_nationkey")
    return s.write("nation", s.table("nation").filter(lambda r: r["n_regionkey"] == 2).select("n_nationkey"), "delete")


@query("SELECT CAST(100 + 10 * (row_number() OVER (ORDER BY n_name) - 1) AS BIGINT) AS id, n_name AS name, 7 AS rank FROM nation")
def dml_defaults_sequence(t):
    t.schema.sequences.add("ids", Sequence("ids", 100, 10))
    t.session.create_table(Table("named", [Column("id", T.INT8, False, Default("sequence", "ids")), Column("name", T.character()), Column("rank", T.INT4, True, Default("immediate", 7))]))
    return t.session.write("named", t.nation.escape(name="n_name"), "insert")


# 4.1 optimiser


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = 5 OR (o_orderkey = 50 AND o_totalprice > 1000) OR (o_orderkey >= 70 AND o_orderkey < 80)")
def opt_or_range_hint(t):
    term = Term(any=(Term("o_orderkey", "=", 5), Term(all=(Term("o_orderkey", "=", 50), Term("o_totalprice", ">", 1000.0))), Term(all=(Term("o_orderkey", ">=", 70), Term("o_orderkey", "<", 80)))))
    return filter_with_range_hint(t.orders, term).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_name LIKE 'Cust%0_1'")
def opt_like_general_prefix(t):
    return t.customer.filter(lambda r: X.like(r["c_name"], "Cust%0_1")).select("c_custkey")


# 2.1, 2.6, 2.10: bounds, limits, exchanges


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 1 AND l_linenumber < 4")
def scan_prefixed_exclusive(t):
    return scan(t.lineitem, ["l_orderkey", "l_linenumber"], Bound("inclusive", (("l_orderkey", 1),)), Bound("prefixed_exclusive", (("l_orderkey", 1), ("l_linenumber", 4))))


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 7)")
def limit_plain(t):
    return t.orders.limit(7).aggregate(n=agg("count"))


@query("SELECT count(DISTINCT n_nationkey) AS n, count(*) AS ids FROM nation")
def identify_counted(t):
    return t.nation.identify("row_id").aggregate(n=agg("count$distinct", lambda r: r["n_nationkey"]), ids=agg("count$distinct", lambda r: X.Expr(T.INT8, r["row_id"].column)))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def exchange_offer(t):
    return exchange.offer(t.nation.escape(key="n_nationkey", name="n_name"), t.region.escape(key="r_regionkey", name="r_name"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS nth FROM customer) WHERE nth <= 2")
def exchange_group(t):
    return exchange.group(t.customer, ["c_nationkey"], [("c_acctbal", "desc"), "c_custkey"], 2).select("c_nationkey", "c_custkey")


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def take_group_flatten(t):
    return exchange.flatten(exchange.take_group(exchange.forward(t.nation), ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"]))


@query("SELECT r_regionkey AS n_regionkey, count(n_nationkey) AS nations, min(n_nationkey) AS lowest FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 4) ON n_regionkey = r_regionkey GROUP BY 1")
def take_cogroup(t):
    some = t.nation.filter(lambda r: r["n_nationkey"] > 4)
    both = exchange.take_cogroup([(some, ["n_regionkey"], False), (t.region, ["r_regionkey"], True)], ["nations", "regions"], ["n_nationkey"])
    return Relation(both.df.select("n_regionkey", F.size("nations").cast("long").alias("nations"), F.get("nations", F.lit(0))["n_nationkey"].alias("lowest")))


# 2.2, 2.4, 2.5, 2.8: statements, indices, expressions over aggregates, correlated subqueries


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'deux'), (3, 'three')) v(k, v)")
def write_statement(t):
    t.session.create_table(Table("written", [Column("k", T.INT4, False), Column("v", T.character())]), ["k"])
    t.session.write_values("written", "insert", ["k", "v"], [[1, "one"], [2, "two"]])
    t.session.write_values("written", "insert_overwrite", ["k", "v"], [[2, "deux"]])
    return t.session.write_values("written", "insert_skip", ["k", "v"], [[1, "un"], [3, "three"]])


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 250000")
def join_find_index(t):
    index = Index("customer_primary", "customer", (("c_custkey", "asc"),))
    return join_find(_big_orders(t), _customers(t), index, {"c_custkey": "o_custkey"}).select("o_orderkey", "c_name")


@query("SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey >= r_regionkey AND n_nationkey < r_regionkey + 3")
def join_scan_index(t):
    index = Index("nation_primary", "nation", (("n_nationkey", "asc"),))
    r = t.region.project(hi=lambda x: x["r_regionkey"] + 3).select("r_regionkey", "hi")
    return join_scan(r, t.nation.select("n_nationkey"), index, {}, (">=", "r_regionkey"), ("<", "hi")).select("r_regionkey", "n_nationkey")


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) + count(*) * 2 AS v FROM lineitem GROUP BY 1")
def agg_expression(t):
    rows = t.lineitem.project(n=lambda r: X.cast(r["l_linenumber"], T.INT8))
    return rows.aggregate(["l_returnflag"], v=lambda g: g.call("sum", rows["n"]) + g.call("count") * 2)


@query("SELECT o_orderkey, (SELECT c_nationkey FROM customer WHERE c_custkey = o_custkey AND c_nationkey > 5) AS nation FROM orders")
def subquery_correlated_scalar(t):
    c = t.customer.filter(lambda r: r["c_nationkey"] > 5).select("c_custkey", "c_nationkey")
    return Q.with_scalar(t.orders.select("o_orderkey", "o_custkey"), "nation", c, "c_nationkey", [("o_custkey", "c_custkey")]).select("o_orderkey", "nation")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = c_custkey)")
def subquery_correlated_in(t):
    return Q.in_(t.customer, lambda r: r["c_nationkey"], t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", keys=[("c_custkey", "s_suppkey")]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND c_acctbal < s_acctbal)")
def subquery_correlated_any(t):
    return Q.quantified(t.customer, "<", "ANY", lambda r: r["c_acctbal"], t.supplier.select("s_nationkey", "s_acctbal"), "s_acctbal", keys=[("c_nationkey", "s_nationkey")]).select("c_custkey")
