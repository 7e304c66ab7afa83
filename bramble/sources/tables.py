"""Sources: scans with ranges, point lookups and literal tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .. import types as T
from ..catalog import Catalog
from ..diagnostics import Code, fail
from ..functions.scalar import Expr, assign, compare, expr
from ..operators.relation import UNBOUND, Bound, Relation, _wide, range_condition
from ..plans.gates import Gates


def parquet(spark: SparkSession, path: str, gates: Gates | None = None, catalog: Catalog | None = None) -> Relation:
    return Relation(spark.read.parquet(path), None, gates, catalog)


def scan(source: Relation, columns: Sequence[str] | None = None, lower: Bound = UNBOUND, upper: Bound = UNBOUND, limit: int | None = None, sort: Sequence[str] = ()) -> Relation:
    """A full or range scan; Catalyst pushes columns and bounds into the files."""
    for bound in (lower, upper):
        for name, value in bound.keys:
            if isinstance(value, Relation):
                raise fail(Code.UNSUPPORTED_FEATURE, "a subquery is unsupported as a key")
            t = source[name].type
            if not t.order_comparable:
                raise fail(Code.INCONSISTENT_TYPE, f"{name} of {t} can't bound a scan")
            assign(value, t)
    where = range_condition(source, lower, upper)
    out = source if where is None else source.filter(where)
    out = out.select(*columns) if columns else out
    return out if limit is None else out.limit(limit, sort=sort)


def find(source: Relation, keys: dict[str, Any], columns: Sequence[str] | None = None) -> Relation:
    """Rows with these values, equal in all keys."""
    if not keys:
        raise fail(Code.INCONSISTENT_ELEMENTS, "a lookup needs a key")
    where = None
    for name, value in keys.items():
        if isinstance(value, Relation):
            raise fail(Code.UNSUPPORTED_FEATURE, "a subquery is unsupported as a key")
        t = source[name].type
        if not t.equality_comparable:
            raise fail(Code.INCONSISTENT_TYPE, f"{name} of {t} can't be looked up")
        term = compare("=", source[name], value)
        where = term if where is None else where & term
    out = source.filter(where)
    return out.select(*columns) if columns else out


def values(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence[Any]], gates: Gates | None = None, catalog: Catalog | None = None) -> Relation:
    """A literal table. Cells of a column are unified; without rows its type is unknown.

    A cell may be a Relation with one column: a scalar subquery, NULL without a row, an
    error with several.
    """
    (gates := gates or Gates()).check("relation_values")
    for row in rows:
        if len(row) != len(names):
            raise fail(Code.INCONSISTENT_ELEMENTS, f"a row has {len(row)} values for {len(names)} columns")
    if not rows:
        schema = S.StructType([S.StructField(n, S.NullType()) for n in names])
        return Relation(spark.createDataFrame([], schema), dict.fromkeys(names, T.UNKNOWN), gates, catalog)
    types: dict[str, T.Type] = {}
    sparks = {}
    for i, name in enumerate(names):
        own = [c.types[c.columns[0]] if isinstance(c, Relation) else expr(c).type for c in (row[i] for row in rows)]
        t = types[name] = T.unify_all(own)
        if t == T.ERROR:
            raise fail(Code.INCONSISTENT_TYPE, f"{name} can't mix " + ", ".join(map(str, own)))
        sparks[name] = _wide(t, *own)
    frames = []
    plain: list[list[Expr]] = []
    for row in rows:
        if any(isinstance(c, Relation) for c in row):
            frames.append(_row_with_subqueries(spark, names, row, sparks))
        else:
            plain.append([expr(c) for c in row])
    if plain:
        cells = [F.struct(*[e.column.cast(sparks[n]).alias(n) for n, e in zip(names, row, strict=True)]) for row in plain]
        frames.insert(0, spark.range(1).select(F.explode(F.array(*cells)).alias("r")).select("r.*"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return Relation(out, types, gates, catalog)


def _row_with_subqueries(spark: SparkSession, names: Sequence[str], row: Sequence[Any], sparks: dict) -> DataFrame:
    from ..operators.subquery import with_scalar

    base = Relation(spark.range(1).select(F.lit(1).alias("__one")))
    for name, cell in zip(names, row, strict=True):
        base = with_scalar(base, name, cell) if isinstance(cell, Relation) else base.project(**{name: cell})
    return base.df.select(*[F.col(n).cast(sparks[n]).alias(n) for n in names])
