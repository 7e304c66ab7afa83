"""Subqueries in expressions: scalar, EXISTS and quantified comparisons, as joins that Catalyst plans.

In strict mode ALL, NOT ANY and NOT IN are rejected, as are quantified comparisons
anywhere but as a condition of their own; otherwise NOT IN is a null-aware anti join.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from .. import types as T
from ..diagnostics import Code, fail
from ..functions.scalar import _COMPARE, NEGATED, Expr, comparison_type, expr
from ..types import Category
from .relation import Relation, _wide


def _single(query: Relation, column: str | None) -> str:
    if column is None and len(query.columns) != 1:
        raise fail(Code.INCONSISTENT_ELEMENTS, "a subquery must have one column here")
    return column or query.columns[0]


def with_scalar(relation: Relation, name: str, query: Relation, column: str | None = None, keys: list[tuple[str, str]] | None = None) -> Relation:
    """Add a column with a subquery's only value: NULL if it has no row, an error if it has several.

    keys: pairs of equal columns (outer, inner) that correlate it; the value is then that of the row's own keys.
    """
    if keys:
        if column is None:
            column = _single(query.select(*[c for c in query.columns if c not in {b for _, b in keys}]), None)
        inner = query.escape(**{f"__k{i}": b for i, (_, b) in enumerate(keys)}, **{name: column})
        joined = relation.join(inner, "left_outer_at_most_one", [(a, f"__k{i}") for i, (a, _) in enumerate(keys)])
        return joined.select(*relation.columns, name)
    own = _single(query, column)
    value = query.df.select(query.df[own].alias("__v"))
    one = value.limit(2).agg(F.count("*").alias("__n"), F.first("__v").alias("__v"))
    checked = one.select(F.when(F.col("__n") > 1, F.raise_error(F.lit("a scalar subquery has more than one row")).cast(value.schema["__v"].dataType)).otherwise(F.col("__v")).alias(name))
    return relation._of(relation.df.crossJoin(F.broadcast(checked)), relation.types | {name: query.types[own]})  # one row by construction


def scalar_filter(relation: Relation, op: str, left: Any, query: Relation, column: str | None = None) -> Relation:
    """Rows of which a value compares so with a scalar subquery."""
    out = with_scalar(relation, "__scalar", query, column)
    kept = out.filter(lambda r: Expr(T.BOOLEAN, _COMPARE[op](relation._expr(left).column, r["__scalar"].column)))
    comparison_type(op, relation._expr(left).type, out.types["__scalar"])
    return kept.select(*relation.columns)


def _condition(relation: Relation, query: Relation, correlated):
    if correlated is None:
        return F.lit(True)
    from .relation import _Pair

    e = expr(correlated(_Pair(relation, query)))
    if e.type.category not in (Category.BOOLEAN, Category.UNKNOWN):
        raise fail(Code.INCONSISTENT_TYPE, "a condition must be boolean")
    return e.column


def exists(relation: Relation, query: Relation, correlated=None, negated: bool = False) -> Relation:
    """WHERE [NOT] EXISTS (query): a semi or anti join. correlated: a condition over the columns of both."""
    relation.gates.check("relation_anti_join" if negated else "relation_semi_join")
    if correlated is None:  # one row says as much as all of them
        return relation._of(relation.df.join(query.df.select(F.lit(1).alias("__x")).limit(1), F.lit(True), "left_anti" if negated else "left_semi"), relation.types)
    return relation._of(relation.df.join(query.df, _condition(relation, query, correlated), "left_anti" if negated else "left_semi"), relation.types)


def with_exists(relation: Relation, name: str, query: Relation, keys: list[tuple[str, str]] | None = None) -> Relation:
    """EXISTS as a value: a boolean column. keys: pairs of equal columns (left, right) that correlate it."""
    if not keys:
        one = query.df.select(F.lit(True).alias("__x")).limit(1)
        out = relation.df.join(F.broadcast(one), F.lit(True), "left")  # one row at most
    else:
        for a, b in keys:
            comparison_type("=", relation[a].type, query[b].type)
        right = query.df.select(*[query.df[b].alias(f"__k{i}") for i, (_, b) in enumerate(keys)]).distinct().withColumn("__x", F.lit(True))
        on = [relation.df[a] == right[f"__k{i}"] for i, (a, _) in enumerate(keys)]
        out = relation.df.join(right, on, "left")
    return relation._of(out.select(*relation.columns, F.col("__x").isNotNull().alias(name)), relation.types | {name: T.BOOLEAN})


def quantified(relation: Relation, op: str, quantifier: str, left: Any, query: Relation, column: str | None = None, negated: bool = False, strict: bool = True, keys: list[tuple[str, str]] | None = None) -> Relation:
    """WHERE [NOT] left op ANY|ALL (query), as a condition of its own.

    op ANY is a semi join on the comparison; NOT (op ALL) is one on its negation. For an
    order only the least or greatest value matters, so one row is compared, not a range join.
    keys: pairs of equal columns (outer, inner) that correlate the query, for ANY and NOT ALL.
    """
    if keys and column is None:
        column = _single(query.select(*[c for c in query.columns if c not in {b for _, b in keys}]), None)
    own = _single(query, column)
    x = relation._expr(left)
    t = comparison_type(op, x.type, query.types[own])
    any_ = quantifier.upper() == "ANY"
    if any_ == negated:
        if strict or keys:
            raise fail(Code.UNSUPPORTED_FEATURE, f"{'NOT ' * negated}{quantifier.upper()} is unsupported here")
        return _universal(relation, op if not negated else NEGATED[op], x, query, own, t)
    relation.gates.check("relation_semi_join")
    op = NEGATED[op] if negated else op
    spark = _wide(t, x.type, query.types[own])
    values = query.df.select(query.df[own].cast(spark).alias("__v"), *[query.df[b].alias(f"__k{i}") for i, (_, b) in enumerate(keys or [])])
    if keys:
        for a, b in keys:
            comparison_type("=", relation[a].type, query.types[b])
        on = _COMPARE[op](x.column.cast(spark), F.col("__v"))
        for i, (a, _) in enumerate(keys):
            on = on & (relation.df[a] == F.col(f"__k{i}"))
        return relation._of(relation.df.join(values, on, "left_semi"), relation.types)
    if op in ("<", "<=", ">", ">="):
        end = values.agg((F.max if op[0] == "<" else F.min)("__v").alias("__v"))
        return relation._of(relation.df.join(F.broadcast(end), _COMPARE[op](x.column, F.col("__v")), "left_semi"), relation.types)  # one row
    if op == "<>":
        ends = values.agg(F.min("__v").alias("__a"), F.max("__v").alias("__b"))
        return relation._of(relation.df.join(F.broadcast(ends), (x.column != F.col("__a")) | (x.column != F.col("__b")), "left_semi"), relation.types)  # one row
    return relation._of(relation.df.join(values, x.column.cast(spark) == F.col("__v"), "left_semi"), relation.types)


def _universal(relation: Relation, op: str, x: Expr, query: Relation, own: str, t: T.Type) -> Relation:
    """left op ALL (query), which NULLs on either side make unknown unless the query is empty."""
    values = query.df.select(query.df[own].cast(_wide(t, x.type, query.types[own])).alias("__v"))
    if op == "<>":
        nulls = values.agg(F.count("*").alias("__n"), F.count("__v").alias("__m"))
        out = relation.df.join(values.where("__v is not null"), x.column == F.col("__v"), "left_anti")
        kept = out.crossJoin(F.broadcast(nulls)).where((F.col("__n") == 0) | ((F.col("__n") == F.col("__m")) & x.column.isNotNull()))
        return relation._of(kept.select(*relation.columns), relation.types)
    ends = values.agg(F.count("*").alias("__n"), F.count("__v").alias("__m"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
    test = {"=": (F.col("__a") == F.col("__b")) & (x.column == F.col("__a")), "<": x.column < F.col("__a"), "<=": x.column <= F.col("__a"), ">": x.column > F.col("__b"), ">=": x.column >= F.col("__b")}[op]
    kept = relation.df.crossJoin(F.broadcast(ends)).where((F.col("__n") == 0) | ((F.col("__n") == F.col("__m")) & test))
    return relation._of(kept.select(*relation.columns), relation.types)


def in_(relation: Relation, left: Any, query: Relation, column: str | None = None, negated: bool = False, strict: bool = True, keys: list[tuple[str, str]] | None = None) -> Relation:
    """WHERE left [NOT] IN (query), which pairs of equal columns (outer, inner) may correlate."""
    return quantified(relation, "=", "ANY", left, query, column, negated, strict, keys)
