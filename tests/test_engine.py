"""Catalog, statements, operators' diagnostics and feature gates."""

import pytest
from pyspark.sql import functions as F

from bramble import types as T
from bramble.catalog import Aggregate, Catalog, Column, Default, Function, Index, Provider, Schema, Sequence, Table, Variable
from bramble.diagnostics import Code, CompileError
from bramble.functions import scalar as X
from bramble.functions.registry import add_aggregate, add_function, call, table_function
from bramble.operators import exchange
from bramble.operators import subquery as Q
from bramble.operators.relation import Bound, Relation, agg
from bramble.plans import dml
from bramble.plans.gates import RESTRICTED, Gates
from bramble.plans.planner import Term, choose_index, estimate_index, plan_json, ranges
from bramble.session import Session
from bramble.sources.tables import find, scan, values


def code(f):
    with pytest.raises(CompileError) as e:
        f()
    return e.value.code


@pytest.fixture
def session(spark):
    return Session(spark)


def rel(spark, names, *rows):
    return values(spark, names.split(), rows)


def rows(x):
    return sorted(map(tuple, (x.df if isinstance(x, Relation) else x).collect()), key=repr)


def test_providers_and_path():
    parent = Provider()
    child = Provider(parent)
    parent.add("a", 1)
    child.add("b", 2)
    assert (child.find("a"), child.find("b"), child.find("c")) == (1, 2, None)
    with pytest.raises(ValueError):
        child.add("b", 3)
    child.add("b", 3, overwrite=True)
    child.add("a", 4)
    assert dict(child.each()) == {"b": 3, "a": 4} and child.remove("a") and child.find("a") == 1
    catalog = Catalog()
    for n in ("one", "two"):
        catalog.add_schema(Schema(n)).storage.add("t", Table("t", [Column(n, T.INT4)]))
    assert catalog.table("t").columns[0].name == "one" and catalog.find("storage", "two.t").columns[0].name == "two"
    assert code(lambda: catalog.table("u")) is Code.UNRESOLVED_VARIABLE


def test_sequences(spark):
    s = Sequence("s", 1, 3, 0, 10)
    block = s.reserve(6)
    nth = spark.range(6)
    assert [r[0] for r in nth.select(block.value(nth.id)).collect()] == [1, 4, 7, 10, 0, 3]
    assert s.next() == 6
    s.restart()
    assert s.next() == 1
    end = Sequence("e", 0, 1, 0, 1, cycle=False)
    assert (end.next(), end.next()) == (0, 1)
    with pytest.raises(OverflowError):
        end.next()
    with pytest.raises(CompileError):
        Sequence("bad", 5, 1, 6, 9)


def test_tables_defaults_and_keys(session):
    col = lambda d, t=T.INT4: Table("x", [Column("c", t, True, d)])
    schema = session.catalog.schemas.find("public")
    schema.sequences.add("s", Sequence("s"))
    add_function(schema, Function("zero", (), T.INT4, lambda: __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0)))
    add_function(schema, table_function("tv", (), {"a": T.INT4}, lambda: None))
    assert code(lambda: session.create_table(col(Default("immediate", "X")))) is Code.INCONSISTENT_TYPE
    assert code(lambda: session.create_table(col(Default("sequence", "none")))) is Code.UNRESOLVED_VARIABLE
    assert code(lambda: session.create_table(col(Default("sequence", "s"), T.character()))) is Code.INCONSISTENT_TYPE
    assert code(lambda: session.create_table(col(Default("function", "tv")))) is Code.INCONSISTENT_FUNCTION_TYPE
    assert code(lambda: session.create_table(col(Default("function", "zero"), T.character()))) is Code.INCONSISTENT_TYPE
    assert code(lambda: session.create_table(Table("x", [Column("c", T.BLOB)]), ["c"])) is Code.INCONSISTENT_TYPE
    assert code(lambda: session.create_table(Table("x", [Column("c", T.UNKNOWN)]))) is Code.UNSUPPORTED_TYPE
    session.create_table(Table("x", [Column("c", T.INT4), Column("d", T.INT4, True, Default("function", "zero")), Column("h", T.INT4, features=frozenset({"hidden"}))]), ["c"])
    assert code(lambda: session.create_table(Table("x", []))) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: session.create_index(Index("i", "x", (("nope", "asc"),)))) is Code.UNRESOLVED_VARIABLE
    session.create_index(Index("i", "x", (("d", "desc"),)))
    assert rows(session.write_values("x", "insert", ["c"], [[1], [2]])) == [(1, 0, None), (2, 0, None)]
    assert session.table("x").columns == ["c", "d"]
    assert code(lambda: session.write_values("x", "insert", ["c"], [[1, 2]])) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: session.write_values("x", "insert", ["c", "d"], [[1]])) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: session.write_values("x", "insert", ["c"], [["a"]])) is Code.INCONSISTENT_TYPE
    with pytest.raises(Exception, match="duplicate key"):
        rows(session.write_values("x", "insert", ["c"], [[1]]))
    session.drop_index("i")
    session.drop_table("x")
    assert code(lambda: session.table("x")) is Code.UNRESOLVED_VARIABLE


def test_writes_on_disk(spark, tmp_path):
    session = Session(spark, str(tmp_path))
    session.catalog.schemas.find("public").sequences.add("s", Sequence("s", 10))
    session.create_table(Table("t", [Column("k", T.INT4), Column("v", T.character(), False, Default("immediate", "x")), Column("n", T.INT8, True, Default("sequence", "s"))]), ["k"])
    session.write_values("t", "insert", ["k"], [[2], [1]])
    assert rows(session.table("t")) == [(1, "x", 10), (2, "x", 11)]
    session.write_values("t", "update", ["k", "v"], [[1, "one"]])
    session.write_values("t", "insert_skip", ["k", "v"], [[1, "no"], [3, "three"]])
    session.write_values("t", "insert_overwrite", ["k", "v"], [[2, "two"]])
    assert [r[:2] for r in rows(session.table("t"))] == [(1, "one"), (2, "two"), (3, "three")]
    session.write_values("t", "delete", ["k"], [[1]])
    assert [r[0] for r in rows(session.table("t"))] == [2, 3]
    session.truncate_table("t", restart_identity=True)
    session.write_values("t", "insert", ["k"], [[7]])
    assert rows(session.table("t")) == [(7, "x", 10)]
    with pytest.raises(Exception, match="must not be null"):
        rows(session.write_values("t", "insert", ["k", "v"], [[8, None]]))
    assert code(lambda: session.write_values("t", "merge", ["k"], [[1]])) is Code.UNSUPPORTED_FEATURE


def test_grants(spark):
    session = Session(spark, user="ann")
    session.register("t", spark.range(3))
    with pytest.raises(PermissionError):
        session.table("t")
    session.grant("t", "ann", "select")
    assert len(rows(session.table("t"))) == 3
    session.revoke("t", "ann", "select")
    with pytest.raises(PermissionError):
        session.table("t")
    session.grant("t", "*", "control")
    assert session.catalog.allowed("t", "bob", "delete")
    assert code(lambda: session.grant("t", "ann", "fly")) is Code.INCONSISTENT_ELEMENTS


def test_overloads(spark, session):
    schema = session.catalog.schemas.find("public")
    from pyspark.sql import functions as F

    add_function(schema, Function("f", (T.INT8,), T.INT8, lambda c: c))
    add_function(schema, Function("f", (T.FLOAT8,), T.FLOAT8, lambda c: c))
    assert call(session.catalog, "f", 1).type == T.INT8 and call(session.catalog, "f", 1.5).type == T.FLOAT8
    assert code(lambda: call(session.catalog, "f", "a")) is Code.INCONSISTENT_TYPE
    assert code(lambda: call(session.catalog, "f")) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: call(session.catalog, "g", 1)) is Code.UNRESOLVED_VARIABLE
    add_function(schema, Function("h", (T.INT8, T.FLOAT8), T.INT8, lambda a, b: a))
    add_function(schema, Function("h", (T.FLOAT8, T.INT8), T.INT8, lambda a, b: b))
    assert code(lambda: call(session.catalog, "h", 1, 1)) is Code.AMBIGUOUS_TYPE
    add_aggregate(schema, Aggregate("mid", (T.FLOAT8,), T.FLOAT8, F.median, incremental=False))
    r = Relation(rel(spark, "a", [1.0], [2.0], [9.0]).df, None, None, session.catalog)
    assert rows(r.aggregate(m=agg("mid", lambda x: x["a"]))) == [(2.0,)]
    assert rows(r.aggregate(m=agg("avg$distinct", lambda x: x["a"]))) == [(4.0,)]


def test_diagnostics(spark, session):
    r = rel(spark, "a b", [1, "x"], [2, None])
    assert code(lambda: r["c"]) is Code.UNRESOLVED_VARIABLE
    assert code(lambda: r.filter(lambda x: x["a"])) is Code.INCONSISTENT_TYPE
    assert code(lambda: r.union(rel(spark, "a", [1]))) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: r.union(rel(spark, "a b", [1, 2]))) is Code.INCONSISTENT_TYPE
    assert code(lambda: r.union(r, [("a", None, "a")], distinct=True)) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: r.join(r)) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: r.join(rel(spark, "c", [1]), "right_outer")) is Code.UNSUPPORTED_FEATURE
    assert code(lambda: r.join(rel(spark, "c", [1]), "full_outer", strategy="broadcast")) is Code.UNSUPPORTED_FEATURE
    assert code(lambda: r.intersection(rel(spark, "c d", ["x", 1]))) is Code.INCONSISTENT_TYPE
    assert code(lambda: values(spark, ["a"], [[1, 2]])) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: values(spark, ["a"], [[1], ["x"]])) is Code.INCONSISTENT_TYPE
    assert values(spark, ["a"], []).types == {"a": T.UNKNOWN}
    assert code(lambda: find(r, {})) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: scan(r, lower=Bound("inclusive", (("a", "x"),)))) is Code.INCONSISTENT_TYPE
    lob = Relation(r.df, {"a": T.INT4, "b": T.CLOB})
    for f in (lambda: lob.distinct("b"), lambda: lob.aggregate(["b"]), lambda: lob.limit(1, sort=["b"]), lambda: lob.limit(1, ["b"]), lambda: lob.union(lob, distinct=True), lambda: lob.filter(lambda x: x["b"] == x["b"])):
        assert code(f) is Code.INCONSISTENT_TYPE
    q = rel(spark, "v", [1])
    for quantifier, negated in (("ALL", False), ("ANY", True)):
        assert code(lambda quantifier=quantifier, negated=negated: Q.quantified(r, "=", quantifier, lambda x: x["a"], q, negated=negated)) is Code.UNSUPPORTED_FEATURE
    assert code(lambda: Q.in_(r, lambda x: x["a"], r)) is Code.INCONSISTENT_ELEMENTS
    seen = session.inspect(lambda: r.filter(lambda x: x["zzz"]))
    assert not seen.ok and seen.diagnostics[0].code is Code.UNRESOLVED_VARIABLE
    assert session.inspect(lambda: r).types == {"a": T.INT4, "b": T.character(1)}
    assert code(lambda: session.variable("v")) is Code.UNRESOLVED_VARIABLE
    session.catalog.schemas.find("public").variables.add("v", Variable("v", T.INT8, 5))
    assert session.variable("v").type == T.INT8


def test_gates(spark):
    r = lambda *f: Relation(rel(spark, "a", [1]).df, None, Gates(f))
    other = rel(spark, "b", [1])
    cases = {
        "relation_buffer": lambda x: x.buffer(2), "relation_identify": lambda x: x.identify("i"), "relation_semi_join": lambda x: x.join(other, "semi", [("a", "b")]),
        "relation_anti_join": lambda x: x.join(other, "anti", [("a", "b")]), "relation_intersection": lambda x: x.intersection(other), "relation_difference": lambda x: x.difference(other),
        "relation_apply": lambda x: x.apply("f", [], []), "exchange_broadcast": exchange.broadcast, "exchange_forward": exchange.forward, "exchange_discard": exchange.discard,
        "exchange_group": lambda x: exchange.group(x, ["a"]), "exchange_aggregate": lambda x: Relation(x.df, None, x.gates, Session(spark).catalog).aggregate(n=agg("count")),
        "statement_write_update": lambda x: dml.update_where(x, X.literal(True), a=2), "statement_write_delete": lambda x: dml.delete_where(x, lambda y: y["a"] == 1), "relation_flatten": lambda x: exchange.flatten(exchange.take_group(x, ["a"])),
        "relation_values": lambda x: values(spark, ["a"], [[1]], x.gates),
    }
    for feature, use in cases.items():
        assert code(lambda feature=feature, use=use: use(r(feature))) is Code.UNSUPPORTED_FEATURE
    assert len(RESTRICTED) == 21
    assert Gates(runtime=()).spark_conf() == {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    with pytest.raises(ValueError):
        Gates(["nothing"])
    s = Session(spark, gates=Gates(["statement_truncate_table"]))
    assert code(lambda: s.truncate_table("t")) is Code.UNSUPPORTED_FEATURE


def test_nulls_and_misses(spark):
    a = rel(spark, "k v", [1, "a"], [None, "b"], [2, "c"], [2, "c"])
    b = rel(spark, "k2", [2], [None], [2], [3])
    assert rows(a.join(b, on=[("k", "k2")]).select("v")) == [("c",)] * 4
    assert rows(a.select("k").intersection(b)) == [(2,), (None,)]
    assert rows(a.select("k").intersection(b, distinct=False)) == [(2,), (2,), (None,)]
    assert rows(a.select("k").difference(b)) == [(1,)]
    assert rows(a.select("k").difference(rel(spark, "k2", [2]), distinct=False)) == [(1,), (2,), (None,)]
    assert rows(Q.in_(a, lambda x: x["k"], b, negated=True, strict=False)) == []
    assert rows(Q.in_(a, lambda x: x["k"], b.filter(lambda x: x["k2"] > 2), negated=True, strict=False).select("v")) == [("a",), ("c",), ("c",)]
    assert len(rows(Q.quantified(a, "<", "ALL", lambda x: x["k"], b.filter(False), strict=False))) == 4
    assert rows(Q.quantified(a, "<>", "ANY", lambda x: x["k"], rel(spark, "q", [2])).select("k")) == [(1,)]
    assert rows(Q.exists(a, b, negated=True)) == [] and len(rows(Q.exists(a, b))) == 4
    assert len(rows(Q.with_exists(a, "e", b.filter(False)).filter(lambda x: ~x["e"]))) == 4
    with pytest.raises(Exception, match="more than one row"):
        rows(a.join(b, "left_outer_at_most_one", [("k", "k2")]))
    with pytest.raises(Exception, match="more than one row"):
        rows(Q.with_scalar(a, "s", b))
    assert rows(a.filter(lambda x: x["k"] == 1).join(b, "left_outer_at_most_one", [("k", "k2")])) == [(1, "a", None)]
    assert rows(dml.update(a.df, rel(spark, "k v", [2, "z"]).df, ["k"])) == [(1, "a"), (2, "z"), (2, "z"), (None, "b")]


def test_apply(spark, session):
    from pyspark.sql import functions as F

    schema = session.catalog.schemas.find("public")
    add_function(schema, table_function("upto", (T.INT8,), {"x": T.INT8, "y": T.INT8}, lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.struct(i.alias("x"), (-i).alias("y"))))))
    r = Relation(rel(spark, "k", [0], [2]).df, None, None, session.catalog)
    assert rows(r.apply("upto", [lambda x: x["k"]], {1: "neg"})) == [(2, -1), (2, -2)]
    assert rows(r.apply("upto", [lambda x: x["k"]], ["x"], outer=True)) == [(0, None), (2, 1), (2, 2)]
    assert code(lambda: r.apply("upto", [lambda x: x["k"]], ["a", "b", "c"])) is Code.INCONSISTENT_ELEMENTS

    @F.udtf(returnType="a: bigint")
    class Twice:
        def eval(self, n):
            yield (n,)
            yield (n * 2,)

    spark.udtf.register("twice", Twice)
    add_function(schema, table_function("twice", (T.INT8,), {"a": T.INT8}, "twice"))
    assert rows(r.apply("twice", [lambda x: x["k"]], ["a"])) == [(0, 0), (0, 0), (2, 2), (2, 4)]


def test_index_choice_and_ranges(spark):
    primary = Index("p", "t", (("a", "asc"), ("b", "asc")), features=frozenset({"primary", "find", "scan", "unique"}))
    second = Index("s", "t", (("c", "asc"),), ("a", "b"))
    found = estimate_index(primary, {"a": "equal", "b": "equal"}, ["a", "b"])
    assert found.score == pytest.approx(1 / (0.1 * 0.1 * 0.125) * 2) and found.attributes == {"find", "single_row", "index_only"}
    assert estimate_index(primary, {"a": "half"}, ["x"]).score == pytest.approx(1 / 0.6)
    assert choose_index([primary, second], {"c": "equal"}, ["a", "c"]).index is second
    assert choose_index([primary, second], {"a": "bounded"}, ["a", "x"]).index is primary
    assert "sorted" in estimate_index(primary, {"a": "equal"}, ["a"], [("b", "asc")]).attributes
    t = Term(any=(Term("a", "=", 1), Term(all=(Term("a", "=", 3), Term("b", ">", 2)))))
    assert ranges(t) == {"a": (1, 3)} and ranges(Term("a", "<>", 1)) == {}
    assert ranges(Term(any=(Term("a", "<", 1), Term("b", "=", 1)))) == {}
    assert plan_json(rel(spark, "a", [1]).df).startswith("[")


def test_interval_join_against_brute_force(spark):
    import random

    from bramble.operators.strategies import interval_join

    rng = random.Random(3)
    inf = float("inf")
    numbers = [*(rng.choice([1, 1e-6, 1e9]) * rng.uniform(-50, 50) for _ in range(150)), 0.0, -0.0, 1.0, 2.0, 4.0, inf, -inf, None]
    ends = [(i, *rng.choice([(a, a + rng.choice([0, 1e-7, 1, 3.5, 1e10])) for a in [rng.choice(numbers[:-1])]] + [(5.0, 4.0), (-inf, 3.0), (2.0, inf), (None, 1.0), (1.0, None)])) for i in range(120)]
    left = spark.createDataFrame(ends, "i int, lo double, hi double").repartition(3)
    right = spark.createDataFrame(list(enumerate(numbers)), "p int, x double").repartition(3)
    got = sorted((r["i"], r["p"]) for r in interval_join(left, "lo", "hi", right, "x", F.expr("lo <= x and x < hi")).collect())
    want = [(i, p) for i, a, b in ends if a is not None and b is not None for p, x in enumerate(numbers) if x is not None and a <= x < b]
    assert got == sorted(want) and len(want) > 100


def test_range_join_without_a_nested_loop(spark):
    """A side that fits in a broadcast is no reason to try all pairs: their number grows with both sides."""
    from bramble.plans.planner import explain

    few, many = Relation(spark.range(20000).selectExpr("id a", "id * 10D lo", "id * 10D + 3 hi")), Relation(spark.range(200000).selectExpr("id b", "id + 0.5D x"))
    terms = [("lo", "<=", "x"), ("hi", ">", "x")]
    for joined in (few.join(many, lower=terms), many.join(few, lower=[(b, {"<=": ">=", ">": "<"}[op], a) for a, op, b in terms])):
        assert "NestedLoop" not in explain(joined.df) and "CartesianProduct" not in explain(joined.df)
        assert joined.df.select("a", "b").agg(F.count("*"), F.countDistinct("a", "b"), F.sum(F.col("b") - 10 * F.col("a"))).first()[:] == (60000, 60000, 60000)


def test_interval_join_cuts_crowded_bins(spark, monkeypatch):
    """Values that crowd in a bin, equal rows and intervals without a width or an end: same pairs, in cells of a bounded number."""
    import random
    from collections import Counter

    from bramble.operators import strategies

    monkeypatch.setattr(strategies, "CELL_PAIRS", 100)
    rng = random.Random(5)
    inf = float("inf")
    points = [*(rng.uniform(90, 100) for _ in range(150)), *[95.0] * 150, *(rng.uniform(-1000, 1000) for _ in range(50)), inf, -inf, None]
    ends = [*((a, a + rng.choice([0.5, 10.0])) for a in (rng.uniform(80, 100) for _ in range(60))), *[(95.0, 95.0)] * 20, *[(94.0, 96.0)] * 20, (-inf, 95.0), (95.0, inf), (None, 1.0), (96.0, 94.0)]
    left, right = spark.createDataFrame(ends, "lo double, hi double").repartition(3), spark.createDataFrame([(x,) for x in points], "x double").repartition(3)
    made = strategies.interval_join(left, "lo", "hi", right, "x", F.expr("lo <= x and x <= hi"))
    want = Counter((a, b, x) for a, b in ends for x in points if None not in (a, b, x) and a <= x <= b)
    assert made.columns == ["lo", "hi", "x"] and Counter(tuple(r) for r in made.collect()) == want
    assert "__cell" in made._jdf.queryExecution().toString()
    sides = [spark.createDataFrame([(3, 7)] * n, "__level int, __bin bigint") for n in (400, 3000)]
    assert strategies._hot(*sides) == [(3, 7, 40, 300)]  # 10 rows of each side to a cell
    assert not strategies._hot(*[spark.createDataFrame([(3, 7)] * n, "__level int, __bin bigint") for n in (10, 10)])


def test_replace_keeps_a_version_for_readers(spark, tmp_path):
    from bramble.sources.commits import ConflictError, versions

    path = str(tmp_path / "t")
    assert dml.replace(spark, spark.range(3), path) == 1
    reader = dml.current(spark, path)
    assert dml.replace(spark, spark.range(5), path) == 2 and reader.count() == 3
    with pytest.raises(ConflictError):
        dml.replace(spark, spark.range(9), path, base=1)
    assert dml.current(spark, path).count() == 5
    dml.replace(spark, dml.current(spark, path).unionAll(spark.range(1)), path)
    assert dml.current(spark, path).count() == 6 and versions(spark, f"{path}/_versions") == [2, 3]
    (tmp_path / "t" / "data-of-a-crashed-writer").mkdir()
    assert dml.current(spark, path).count() == 6


def test_insert_finds_duplicates(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    assert sorted(dml.insert(old, new((2, "c"), (3, "c")), ["k"]).collect(), key=str) == sorted([(1, "a"), (None, "b"), (2, "c"), (3, "c")], key=str)
    for rows in ([(1, "z")], [(None, "z")], [(5, "x"), (5, "y")]):
        with pytest.raises(Exception, match="duplicate key"):
            dml.insert(old, new(*rows), ["k"]).collect()


def test_all_copies_by_key_pairs(spark):
    left = Relation(spark.createDataFrame([(i % 4 if i % 5 else None, i) for i in range(60)], "k int, v int").repartition(7))
    right = Relation(spark.createDataFrame([(k,) for k in [0] * 4 + [1] * 99 + [None] * 3 + [9]], "r int"))
    sizes = lambda x: {r["k"]: r["n"] for r in x.df.groupBy("k").agg(F.count("*").alias("n")).collect()}
    had = sizes(left)
    both, rest = (sizes(f([("k", "r")], distinct=False)) for f in (lambda *a, **k: left.intersection(right, *a, **k), lambda *a, **k: left.difference(right, *a, **k)))
    assert both == {0: 4, 1: had[1], None: 3}
    assert rest == {0: had[0] - 4, 2: had[2], 3: had[3], None: had[None] - 3}


def test_groups_and_cogroups(spark):
    a = Relation(spark.createDataFrame([(1, 9), (1, 7), (None, 5), (2, 1)], "k int, v int"))
    b = Relation(spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "q long, w string"))
    groups = exchange.take_group(a, ["k"], sort=["v"])
    assert {r["k"]: [x["v"] for x in r["group"]] for r in groups.df.collect()} == {1: [7, 9], None: [5], 2: [1]}
    flat = exchange.flatten(groups)
    assert flat.types == a.types and sorted(map(repr, flat.df.collect())) == sorted(map(repr, a.df.collect()))
    for mandatory, keys in (((False, False), {1, None, 2, 4}), ((True, False), {1, None, 2}), ((True, True), {1, None})):
        both = exchange.take_cogroup([(a, ["k"], mandatory[0]), (b, ["q"], mandatory[1])], ["left", "right"], ["v"])
        assert both.types["k"] == T.INT8
        got = {r["k"]: ([x["v"] for x in r["left"]], [x["w"] for x in r["right"]]) for r in both.df.collect()}
        assert set(got) == keys and got[1] == ([7, 9], ["x"]) and got[None] == ([5], ["y"])
    assert code(lambda: exchange.take_cogroup([(a, ["k"], False), (b, ["w"], False)], ["l", "r"])) is Code.INCONSISTENT_TYPE
    assert code(lambda: exchange.flatten(a, "v")) is Code.INCONSISTENT_TYPE and code(lambda: exchange.group(a, [])) is Code.INCONSISTENT_ELEMENTS
    assert exchange.group(a, [], limit=2, or_whole=True).df.count() == 2 and exchange.take_flat(a, "v").columns == ["v"]


def test_index_joins_and_rejections(spark, session):
    from bramble.operators.index_joins import join_find, join_scan

    a, b = Relation(spark.createDataFrame([(1, 2)], "x int, y int")), Relation(spark.createDataFrame([(1, 2), (1, 3)], "k int, l int"))
    index = Index("i", "b", (("k", "asc"), ("l", "asc")))
    assert rows(join_find(a, b, index, {"k": "x", "l": "y"})) == [(1, 2, 1, 2)]
    assert rows(join_scan(a, b, index, {"k": "x"}, (">", "y"))) == [(1, 2, 1, 3)]
    assert code(lambda: join_find(a, b, index, {"k": "x"})) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: join_scan(a, b, index, {"l": "x"})) is Code.INCONSISTENT_ELEMENTS
    assert code(lambda: join_scan(a, b, Index("i", "b", (("k", "asc"),), features=frozenset({"find"})), {"k": "x"})) is Code.UNSUPPORTED_FEATURE
    for gate, f in (("relation_join_find", lambda r: join_find(r, b, index, {"k": "x", "l": "y"})), ("relation_join_scan", lambda r: join_scan(r, b, index, {"k": "x"}))):
        assert code(lambda: f(Relation(a.df, None, Gates([gate])))) is Code.UNSUPPORTED_FEATURE
        assert code(lambda: f(Relation(a.df, None, Gates(runtime=[])))) is Code.UNSUPPORTED_FEATURE
    one = b.select("k").limit(1)
    for f in (lambda: find(a, {"x": one}), lambda: scan(a, lower=Bound("inclusive", (("x", one),))), lambda: a.join(b, condition=lambda r: one), lambda: a.filter(lambda r: one)):
        assert code(f) is Code.UNSUPPORTED_FEATURE
    seen = session.inspect(lambda: a.filter(lambda r: r["no"]), lambda: a, lambda: a.aggregate(["x"], v=lambda g: g["y"]))
    assert [d.code for d in seen.diagnostics] == [Code.UNRESOLVED_VARIABLE, Code.INCONSISTENT_ELEMENTS] and not seen.types and seen.diagnostics[0].region


def test_keys_need_what_their_index_can(session):
    flags = Table("flags", [Column("f", T.array(T.INT4))])
    assert code(lambda: session.create_table(flags, ["f"])) is Code.INCONSISTENT_TYPE


def test_unique_keys(spark):
    session = Session(spark)
    session.create_table(Table("u", [Column("k", T.INT4, False), Column("a", T.INT4), Column("b", T.INT4)]), ["k"], [["a", "b"]])
    session.write_values("u", "insert", ["k", "a", "b"], [[1, 1, 1], [2, 1, None], [3, 1, None]])
    assert len(rows(session.write_values("u", "insert", ["k", "a", "b"], [[4, 1, 2], [5, 1, None]]))) == 5
    with pytest.raises(Exception, match="duplicate key in a, b"):
        rows(session.write_values("u", "insert", ["k", "a", "b"], [[6, 1, 2]]))


def test_let_evaluates_once(spark):
    drawn = X.Expr(T.FLOAT8, F.rand())
    r = Relation(spark.range(200).toDF("i")).project(v=X.let(drawn, lambda v: X.compare("=", v, v)), w=X.let(drawn, lambda v: v - v))
    assert {(x["v"], x["w"]) for x in r.df.collect()} == {(True, 0.0)}
    assert "element_at" not in str(X.between(r["i"], 1, 2).column)


def test_options_and_named_types(spark):
    from bramble.plans.gates import Options
    from bramble.plans.planner import explain

    seen = {}
    for hint, inline in ((True, True), (False, False)):
        session = Session(spark, options=Options(hint, inline))
        schema = session.catalog.schemas.find("public")
        schema.variables.add("x", Variable("x", T.INT4, 7))
        schema.types.add("money", T.declared("money", T.decimal(12, 2)))
        r = session.register("r", spark.range(20).selectExpr("cast(id as int) as a", "cast(id as int) as b"))
        term = Term(any=(Term("a", "=", 1), Term(all=(Term("a", "=", 3), Term("b", ">", 2)))))
        seen[hint] = rows(session.filter(r, term)), rows(r.filter(lambda x: x["a"] == session.variable("x")).select("b"))
        plan = explain(r.filter(lambda x: x["a"] == session.variable("x")).df)
        assert ("element_at" in plan) != inline
        made = session.create_table(Table("priced", [Column("k", T.INT4), Column("p", T.declared("money"))]))
        assert T.to_spark(made.column("p").type).simpleString() == "decimal(12,2)"
        assert code(lambda: session.create_table(Table("bad", [Column("p", T.declared("nothing"))]))) is Code.UNSUPPORTED_TYPE
    assert seen[True] == seen[False] and seen[True][1] == [(7,)]
