"""Functions and aggregates: the standard aggregates, and calls resolved over overloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import types as T
from ..catalog import Aggregate, Catalog, Function, Schema
from ..diagnostics import Code, fail
from ..types import Type
from .scalar import Expr, assign, expr

DISTINCT = "$distinct"


def _avg_distinct(c: Column) -> Column:
    return F.sum_distinct(c) / F.count_distinct(c)


def standard_aggregates(schema: Schema) -> None:
    """count, sum, avg, min and max, each also over distinct values (`name$distinct`)."""
    numbers = (T.INT4, T.INT8, T.decimal(), T.FLOAT4, T.FLOAT8)
    ordered = (*numbers, T.character(), T.octet(), T.DATE, T.time_of_day(), T.time_point(), T.time_point(True))
    counted = (*ordered, T.BOOLEAN)

    def add(name: str, parameters: tuple[Type, ...], returns: Type, body: Callable) -> None:
        schema.aggregates.find(name) or schema.aggregates.add(name, [])
        schema.aggregates.find(name).append(Aggregate(name, parameters, returns, body, id=10_000))

    add("count", (), T.INT8, lambda: F.count(F.lit(1)))
    for t in counted:
        add("count", (t,), T.INT8, F.count)
        add("count" + DISTINCT, (t,), T.INT8, F.count_distinct)
    for t in numbers:
        total = {"int4": T.INT8, "float4": T.FLOAT8}.get(t.kind, t)
        mean = T.decimal() if t.kind == "decimal" else T.FLOAT8
        add("sum", (t,), total, F.sum)
        add("sum" + DISTINCT, (t,), total, F.sum_distinct)
        add("avg", (t,), mean, F.avg)
        add("avg" + DISTINCT, (t,), mean, _avg_distinct)
    for t in ordered:
        for name, f in (("min", F.min), ("max", F.max)):
            add(name, (t,), t, f)
            add(name + DISTINCT, (t,), t, f)


def resolve(candidates: list, arguments: list[Type], name: str):
    """The overload that arguments apply to with the least widening; ambiguous if two remain that none decides between."""
    arity = [c for c in candidates if len(c.parameters) == len(arguments)]
    if not arity:
        raise fail(Code.INCONSISTENT_ELEMENTS if candidates else Code.UNRESOLVED_VARIABLE, f"there is no {name} of {len(arguments)} arguments")
    fit = [c for c in arity if all(map(T.applicable, arguments, c.parameters))]
    if not fit:
        if len(arity) == 1 and all(map(T.assignable, arguments, arity[0].parameters)):
            return arity[0]
        raise fail(Code.INCONSISTENT_TYPE, f"{name} can't take " + ", ".join(map(str, arguments)))
    exact = [c for c in fit if all(a.kind == p.kind for a, p in zip(arguments, c.parameters, strict=True))]
    best = exact or [c for c in fit if not any(o is not c and _narrower(o.parameters, c.parameters) for o in fit)]
    if len(best) > 1 and not all(b.parameters == best[0].parameters for b in best):
        raise fail(Code.AMBIGUOUS_TYPE, f"{name} is ambiguous for " + ", ".join(map(str, arguments)))
    return best[0]


def _narrower(a: tuple[Type, ...], b: tuple[Type, ...]) -> bool:
    return a != b and all(map(T.applicable, a, b))


def call(catalog: Catalog, name: str, *arguments) -> Expr:
    """A scalar function's call."""
    args = [expr(a) for a in arguments]
    found = resolve(catalog.overloads("functions", name), [a.type for a in args], name)
    if found.table_valued:
        raise fail(Code.INCONSISTENT_FUNCTION_TYPE, f"{name} returns a table; it can only be applied")
    columns = [assign(a, p).column for a, p in zip(args, found.parameters, strict=True)]
    column = found.body(*columns) if callable(found.body) else F.call_function(found.body, *columns)
    return Expr(found.returns, column)


def aggregate_call(catalog: Catalog, name: str, *arguments) -> tuple[Expr, Aggregate]:
    """An aggregate's call, for a grouping's list."""
    args = [expr(a) for a in arguments]
    found = resolve(catalog.overloads("aggregates", name), [a.type for a in args], name)
    columns = [a.column if a.type.kind == p.kind else assign(a, p).column for a, p in zip(args, found.parameters, strict=True)]
    return Expr(found.returns, found.body(*columns)), found


def table_function(name: str, parameters: tuple[Type, ...], columns: dict[str, Type], body: Callable[..., Column] | str) -> Function:
    """A table-valued function. body: columns to an array of structs (stays in the JVM), or the name of a registered UDTF."""
    return Function(name, parameters, T.table(**columns), body)


def add_function(schema: Schema, function: Function) -> Function:
    schema.functions.find(function.name) or schema.functions.add(function.name, [])
    schema.functions.find(function.name).append(function)
    return function


def add_aggregate(schema: Schema, aggregate: Aggregate) -> Aggregate:
    schema.aggregates.find(aggregate.name) or schema.aggregates.add(aggregate.name, [])
    schema.aggregates.find(aggregate.name).append(aggregate)
    return aggregate


def grouped(df: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """One row for each key; without keys exactly one row, on empty input too."""
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
