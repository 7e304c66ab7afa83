"""Relational operators: typed DataFrames. Catalyst plans and runs them; nothing runs here."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .. import types as T
from ..catalog import Catalog
from ..diagnostics import Code, fail
from ..functions import registry
from ..functions.scalar import Expr, compare, comparison_type, expr
from ..plans.gates import Gates
from ..types import Category, Type
from .strategies import broadcast_if_small, interval_join, is_number, loops_cheaply

JOIN_KINDS = ("inner", "left_outer", "left_outer_at_most_one", "full_outer", "semi", "anti")
_SEVERAL = "more than one row matches in an at-most-one join"
_SPARK_JOINS = {"inner": "inner", "left_outer": "left", "full_outer": "full", "semi": "left_semi", "anti": "left_anti"}


@dataclass(frozen=True)
class Aggregation:
    """A column of `aggregate`: a function's name and its arguments."""

    name: str
    arguments: tuple = ()


def agg(name: str, *arguments) -> Aggregation:
    return Aggregation(name, arguments)


@dataclass(frozen=True)
class Bound:
    """An end of a range: values for a prefix of the keys.

    inclusive / exclusive: rows up to, or before, these values of the whole key given.
    prefixed_*: equality on all keys but the last one given, and a bound on that.
    """

    kind: str  # unbound, inclusive, exclusive, prefixed_inclusive, prefixed_exclusive
    keys: tuple[tuple[str, Any], ...] = ()


UNBOUND = Bound("unbound")


def range_condition(relation: Relation, lower: Bound, upper: Bound) -> Expr | None:
    """A range as a conjunction of comparisons, which Catalyst pushes into the scan."""
    terms: dict[tuple, Expr] = {}
    for bound, sign in ((lower, ">"), (upper, "<")):
        if bound.kind == "unbound":
            continue
        *prefix, last = bound.keys
        for name, value in prefix:
            terms[name, "=", str(value)] = compare("=", relation[name], value)
        op = sign + ("=" if bound.kind.endswith("inclusive") else "")
        terms[last[0], op, str(last[1])] = compare(op, relation[last[0]], last[1])
    out = None
    for term in terms.values():
        out = term if out is None else out & term
    return out


class Relation:
    """Columns with types over a DataFrame."""

    def __init__(self, df: DataFrame, types: dict[str, Type] | None = None, gates: Gates | None = None, catalog: Catalog | None = None):
        self.df = df
        self.types = types or {f.name: T.from_spark(f.dataType, f.metadata) for f in df.schema.fields}
        self.gates, self.catalog = gates or Gates(), catalog or Catalog()

    def _of(self, df: DataFrame, types: dict[str, Type]) -> Relation:
        return Relation(df, types, self.gates, self.catalog)

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    def __getitem__(self, name: str) -> Expr:
        if name not in self.types:
            raise fail(Code.UNRESOLVED_VARIABLE, f"there is no column {name}")
        return Expr(self.types[name], self.df[name])

    def _expr(self, x: Any) -> Expr:
        made = x(self) if callable(x) and not isinstance(x, Expr) else x
        if isinstance(made, Relation):
            raise fail(Code.UNSUPPORTED_FEATURE, "a subquery is unsupported here")
        return expr(made)

    def _key(self, name: str, order: bool, what: str) -> Expr:
        e = self[name]
        if not (e.type.order_comparable if order else e.type.equality_comparable):
            raise fail(Code.INCONSISTENT_TYPE, f"{what}: {name} of {e.type} can't be compared")
        return e

    # --- 2.1, 2.3: columns and rows ---

    def project(self, **columns: Any) -> Relation:
        """Add columns, or replace them; later ones may use earlier ones. Values are expressions, or functions of the relation."""
        out = self
        for name, value in columns.items():
            e = out._expr(value)
            out = out._of(out.df.withColumn(name, e.column), out.types | {name: e.type})
        return out

    def filter(self, condition: Any) -> Relation:
        """Rows for which the condition is true; an untyped NULL is a condition that never is."""
        e = self._expr(condition)
        if e.type.category not in (Category.BOOLEAN, Category.UNKNOWN, Category.UNRESOLVED):
            raise fail(Code.INCONSISTENT_TYPE, f"a condition must be boolean, not {e.type}")
        return self._of(self.df.where(e.column.cast("boolean") if e.type.kind == "unknown" else e.column), self.types)

    def select(self, *names: str) -> Relation:
        for n in names:
            self[n]
        return self._of(self.df.select(*names), {n: self.types[n] for n in names})

    def escape(self, **mapping: str) -> Relation:
        """Rename columns, new=old; the others stay behind."""
        return self._of(self.df.select(*[self[old].column.alias(new) for new, old in mapping.items()]), {new: self.types[old] for new, old in mapping.items()})

    subquery = escape

    def identify(self, name: str) -> Relation:
        """Add a row id."""
        self.gates.check("relation_identify")
        return self._of(self.df.withColumn(name, F.monotonically_increasing_id()), self.types | {name: T.ROW_ID})

    def buffer(self, n: int) -> list[Relation]:
        """One input for n consumers; Spark reuses the exchange where they share one."""
        self.gates.check("relation_buffer")
        return [self._of(self.df, self.types) for _ in range(n)]

    def emit(self, *columns: str, **renamed: str) -> DataFrame:
        """The result: columns by name, or new=old; all of them by default."""
        if not columns and not renamed:
            return self.df.select(*self.columns)
        return self.df.select(*[self[c].column for c in columns], *[self[old].column.alias(new) for new, old in renamed.items()])

    def apply(self, name: str, arguments: Sequence[Any], columns: dict[int, str] | Sequence[str], outer: bool = False) -> Relation:
        """Join each row with what a table-valued function returns for it; `columns` names the results by position."""
        self.gates.check("relation_apply")
        args = [self._expr(a) for a in arguments]
        found = registry.resolve(self.catalog.overloads("functions", name), [a.type for a in args], name)
        if not found.table_valued:
            raise fail(Code.INCONSISTENT_FUNCTION_TYPE, f"{name} does not return a table")
        names = dict(enumerate(columns)) if not isinstance(columns, dict) else columns
        fields = found.returns.elements
        if any(not 0 <= i < len(fields) for i in names):
            raise fail(Code.INCONSISTENT_ELEMENTS, f"{name} returns {len(fields)} columns")
        values = [a.column.cast(T.to_spark(p)) for a, p in zip(args, found.parameters, strict=True)]
        types = self.types | {n: fields[i][1] for i, n in names.items()}
        if callable(found.body):
            rows = found.body(*values)
            made = self.df.withColumn("__row", (F.explode_outer if outer else F.explode)(rows))
            return self._of(made.select(*self.columns, *[F.col("__row").getField(fields[i][0]).alias(n) for i, n in names.items()]), types)
        spark, args_ = self.df.sparkSession, [f"__a{i}" for i in range(len(values))]
        spark_view = f"apply_{id(self):x}"
        self.df.select(*self.columns, *[v.alias(a) for v, a in zip(values, args_, strict=True)]).createOrReplaceTempView(spark_view)
        lateral = f"LATERAL {found.body}({', '.join('t.' + a for a in args_)}) AS f({', '.join(f'c{i}' for i in range(len(fields)))})"
        joined = f"{spark_view} t LEFT JOIN {lateral} ON true" if outer else f"{spark_view} t, {lateral}"
        picked = ", ".join([*(f"t.`{c}`" for c in self.columns), *(f"f.c{i} AS `{n}`" for i, n in names.items())])
        out = spark.sql(f"SELECT {picked} FROM {joined}")
        spark.catalog.dropTempView(spark_view)
        return self._of(out, types)

    # --- 2.4: joins ---

    def join(self, other: Relation, kind: str = "inner", on: Sequence[tuple[str, str]] = (), condition: Callable[[Relation], Expr] | None = None, strategy: str | None = None, lower: Sequence[tuple[str, str, str]] = ()) -> Relation:
        """Join on pairs of equal keys, range terms (left, operator, right) and a condition over the columns of both.

        kinds: inner, left_outer, left_outer_at_most_one (a second match is an error when it
        is met), full_outer, semi, anti. Names must differ between the sides.
        strategy: broadcast (if Spark's estimate of the right side bears it out), merge or hash; by
        default Spark decides. An inner join on range terms alone that put a number of one
        side between two of the other is laid out by bins unless there are few pairs to try.
        """
        if kind not in JOIN_KINDS:
            raise fail(Code.UNSUPPORTED_FEATURE, f"there is no {kind} join")
        if kind in ("semi", "anti"):
            self.gates.check(f"relation_{kind}_join")
        if clash := set(self.types) & set(other.types):
            raise fail(Code.INCONSISTENT_ELEMENTS, f"both sides have {sorted(clash)}")
        left, right = self.df, other.df
        if strategy == "broadcast":
            self.gates.check("exchange_broadcast")
            if kind == "full_outer":
                raise fail(Code.UNSUPPORTED_FEATURE, "a full outer join can't broadcast a side")
            if {"broadcast_exchange", *(["broadcast_join_scan"] if lower else [])} <= self.gates.runtime:
                right = broadcast_if_small(right)
        elif strategy in ("merge", "hash"):
            right = right.hint({"merge": "merge", "hash": "shuffle_hash"}[strategy])
        elif strategy is not None:
            raise fail(Code.UNSUPPORTED_FEATURE, f"there is no join strategy {strategy}")
        both = _Pair(self, other)
        if any(isinstance(x, Relation) for term in (*on, *lower) for x in term):
            raise fail(Code.UNSUPPORTED_FEATURE, "a subquery is unsupported as a join's key")
        terms = [compare("=", both[a], both[b]) for a, b in on] + [compare(op, both[a], both[b]) for a, op, b in lower]
        if condition is not None:
            e = self._expr(condition(both))
            if e.type.category not in (Category.BOOLEAN, Category.UNKNOWN):
                raise fail(Code.INCONSISTENT_TYPE, f"a join condition must be boolean, not {e.type}")
            terms.append(Expr(T.BOOLEAN, e.column.cast("boolean")))
        where = None
        for t in terms:
            where = t.column if where is None else where & t.column
        if kind == "left_outer_at_most_one":
            if on and condition is None and not lower and all(self.df.schema[a].dataType == other.df.schema[b].dataType for a, b in on):
                return self._at_most_one_by_key(other, on, strategy)
            return self._at_most_one(other, right, where)
        if kind == "inner" and not on and (interval := self._interval(other, lower)) and not loops_cheaply(left, right):
            return self._of(interval_join(*interval, where).select(*self.types, *other.types), self.types | other.types)
        if where is None and kind == "inner":
            return self._of(left.crossJoin(right), self.types | other.types)
        out = left.join(right, F.lit(True) if where is None else where, _SPARK_JOINS[kind])
        return self._of(out, self.types if kind in ("semi", "anti") else self.types | other.types)

    def _interval(self, other: Relation, lower: Sequence[tuple[str, str, str]]) -> tuple[DataFrame, str, str, DataFrame, str] | None:
        """The interval side with its ends, and the side of the points, if range terms bound a number of one side by two of the other."""
        for own, far, terms in ((self, other, lower), (other, self, [(b, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), a) for a, op, b in lower])):
            for low, op, point in terms:
                if op not in ("<", "<="):
                    continue
                for high, op_, point_ in terms:
                    if op_ in (">", ">=") and point_ == point and all(is_number(*x) for x in ((own.df, low), (own.df, high), (far.df, point))):
                        return own.df, low, high, far.df, point
        return None

    def _at_most_one_by_key(self, other: Relation, on: Sequence[tuple[str, str]], strategy: str | None) -> Relation:
        """One row for each key on the right, with how many it had: an error where a key with several is met."""
        keys = [b for _, b in on]
        rest = [c for c in other.types if c not in keys]
        one = other.df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__m"), *[F.first(c).alias(c) for c in rest])
        one = broadcast_if_small(one) if strategy == "broadcast" else one.hint({"merge": "merge", "hash": "shuffle_hash"}[strategy]) if strategy else one
        where = None
        for a, b in on:
            term = self.df[a] == one[b]
            where = term if where is None else where & term
        joined = self.df.join(one, where, "left")
        checked = F.when(F.col("__m") > 1, F.raise_error(F.lit(_SEVERAL))).otherwise(F.lit(True))
        return self._of(joined.withColumn("__ok", checked.cast("boolean")).where("__ok").select(*self.types, *other.types), self.types | other.types)

    def _at_most_one(self, other: Relation, right: DataFrame, where: Column | None) -> Relation:
        marked, mark = self.df.withColumn("__row_id", F.monotonically_increasing_id()), right.withColumn("__there", F.lit(1))
        joined = marked.join(mark, F.lit(True) if where is None else where, "left")
        matches = F.count("__there").over(Window.partitionBy("__row_id"))
        checked = F.when(matches > 1, F.raise_error(F.lit(_SEVERAL))).otherwise(F.lit(True))
        names = [*self.types, *other.types]
        return self._of(joined.withColumn("__ok", checked.cast("boolean")).where("__ok").select(*names), self.types | other.types)

    # --- 2.5: aggregation ---

    def aggregate(self, keys: Sequence[str] = (), **columns: Aggregation) -> Relation:
        """One row for each group; without keys exactly one. Distinct aggregates are named `name$distinct`.

        A column may also be a function of the relation: an expression over calls of `call`,
        which are aggregates there and nowhere else, and keys.
        """
        keys = list(dict.fromkeys(keys))
        for k in keys:
            self._key(k, False, "GROUP BY")
        made: dict[str, tuple[Expr, list]] = {}
        for n, a in columns.items():
            if isinstance(a, Aggregation):
                e, found = registry.aggregate_call(self.catalog, a.name, *[self._expr(x) for x in a.arguments])
                made[n] = e, [found]
            else:
                group = _Group(self, keys)
                made[n] = self._expr(a(group)), group.called
        if all(f.incremental for _, called in made.values() for f in called):
            self.gates.check("exchange_aggregate")
        out = registry.grouped(self.df, keys, [e.column.alias(n) for n, (e, _) in made.items()]) if made else self.df.select(*keys).distinct()
        return self._of(out, {k: self.types[k] for k in keys} | {n: e.type for n, (e, _) in made.items()})

    def distinct(self, *keys: str) -> Relation:
        """One row, whichever, for each value of the keys (of all columns by default)."""
        keys = keys or tuple(self.columns)
        for k in keys:
            self._key(k, False, "DISTINCT")
        return self._of(self.df.dropDuplicates(list(keys)), self.types)

    # --- 2.6 ---

    def limit(self, n: int | None, group: Sequence[str] = (), sort: Sequence[str | tuple[str, str]] = ()) -> Relation:
        """The first n rows, of each group if one is given, in an order if one is given. Nulls come first, descending last."""
        order = []
        for s in sort:
            name, direction = (s, "asc") if isinstance(s, str) else s
            c = self._key(name, True, "ORDER BY").column
            order.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_first())
        for g in group:
            self._key(g, False, "LIMIT")
        if group:
            if n is None:
                return self._of(self.df.repartition(*group).sortWithinPartitions(*group, *order), self.types)
            nth = F.row_number().over(Window.partitionBy(*group).orderBy(*(order or [F.lit(1)])))
            return self._of(self.df.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth"), self.types)
        df = self.df.orderBy(*order) if order else self.df
        return self._of(df if n is None else df.limit(n), self.types)

    # --- 2.7: set operations ---

    def union(self, other: Relation, mapping: Sequence[tuple[str | None, str | None, str]] | None = None, distinct: bool = False) -> Relation:
        """Rows of both. mapping: (left column, right column, name); one of them may be None (an outer union) unless distinct."""
        mapping = mapping or self._positions(other)
        left, right, types = [], [], {}
        for a, b, name in mapping:
            if a is None and b is None or distinct and None in (a, b):
                raise fail(Code.INCONSISTENT_ELEMENTS, f"{name} needs a column of both sides")
            x, y = (self[a] if a else expr(None)), (other[b] if b else expr(None))
            t = T.unify(x.type, y.type)
            if t == T.ERROR and not T.is_unresolved(x.type, y.type):
                raise fail(Code.INCONSISTENT_TYPE, f"{name} can't be of {x.type} and {y.type}")
            if distinct and not t.equality_comparable:
                raise fail(Code.INCONSISTENT_TYPE, f"{name} of {t} can't be compared")
            spark = _wide(t, x.type, y.type)
            left.append(x.column.cast(spark).alias(name))
            right.append(y.column.cast(spark).alias(name))
            types[name] = t
        out = self.df.select(*left).unionAll(other.df.select(*right))
        return self._of(out.distinct() if distinct else out, types)

    def _positions(self, other: Relation) -> list[tuple[str, str, str]]:
        if len(self.types) != len(other.types):
            raise fail(Code.INCONSISTENT_ELEMENTS, "both sides must have the same number of columns")
        return [(a, b, a) for a, b in zip(self.types, other.types, strict=True)]

    def _set(self, other: Relation, keys: Sequence[tuple[str, str]] | None, distinct: bool, kind: str) -> Relation:
        pairs = list(keys) if keys else [(a, b) for a, b, _ in self._positions(other)]
        for a, b in pairs:
            comparison_type("=", self[a].type, other[b].type)
        names = [a for a, _ in pairs]
        cast = [_wide(T.unify(self[a].type, other[b].type), self[a].type, other[b].type) for a, b in pairs]
        right = other.df.select(*[other[b].column.cast(t).alias(f"__k{i}") for i, ((_, b), t) in enumerate(zip(pairs, cast, strict=True))])
        left = self.df.select(*[self.df[c] for c in self.columns], *[self[a].column.cast(t).alias(f"__l{i}") for i, (a, t) in enumerate(zip(names, cast, strict=True))])
        n = len(pairs)
        if not distinct and keys is None:
            own = self.df.select(*[F.col(a).cast(t).alias(a) for a, t in zip(names, cast, strict=True)])
            out = own.intersectAll(right) if kind == "left_semi" else own.exceptAll(right)
            return self._of(out.select(*[F.col(c).cast(self.df.schema[c].dataType).alias(c) for c in names]), self.types)
        if not distinct:  # nth copies of a key meet; nulls are equal
            left = _nth_of_key(left, [f"__l{i}" for i in range(n)], "__n")
            right = right.groupBy(*[f"__k{i}" for i in range(n)]).agg(F.count("*").alias("__m"))
        else:
            left, right = left.dropDuplicates([f"__l{i}" for i in range(n)]), right.distinct()
        on = None
        for i in range(n):
            term = F.col(f"__l{i}").eqNullSafe(F.col(f"__k{i}"))
            on = term if on is None else on & term
        if not distinct:
            on = on & (F.col("__n") <= F.col("__m"))
        return self._of(left.join(right, on, kind).select(*self.columns), self.types)

    def intersection(self, other: Relation, keys: Sequence[tuple[str, str]] | None = None, distinct: bool = True) -> Relation:
        """Left rows whose keys are on the right too; ALL keeps as many copies as both have. Nulls are equal."""
        self.gates.check("relation_intersection")
        return self._set(other, keys, distinct, "left_semi")

    def difference(self, other: Relation, keys: Sequence[tuple[str, str]] | None = None, distinct: bool = True) -> Relation:
        """Left rows whose keys aren't on the right; ALL takes one copy away for each on the right. Nulls are equal."""
        self.gates.check("relation_difference")
        return self._set(other, keys, distinct, "left_anti")


def _nth_of_key(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 1, without all of a key's rows in one task: within each input partition, plus those of the partitions before it."""
    part = df.withColumn("__part", F.spark_partition_id())
    here = part.withColumn("__here", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(F.lit(1))))
    counts = part.groupBy(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p")).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*[f"__b{i}" for i in range(len(keys))]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__base", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")  # a row for each key and partition
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__b{i}"))
    return here.join(counts, on).withColumn(name, F.col("__base") + F.col("__here")).select(*df.columns, name)


class _Group:
    """A relation's groups, for expressions over aggregates: keys by name, aggregates by `call`."""

    def __init__(self, relation: Relation, keys: Sequence[str]):
        self.relation, self.keys, self.called = relation, keys, []

    def __getitem__(self, name: str) -> Expr:
        if name not in self.keys:
            raise fail(Code.INCONSISTENT_ELEMENTS, f"{name} is no key of the group")
        return self.relation[name]

    def call(self, name: str, *arguments: Any) -> Expr:
        e, found = registry.aggregate_call(self.relation.catalog, name, *[self.relation._expr(x) for x in arguments])
        self.called.append(found)
        return e


class _Pair:
    """The columns of both sides of a join, for its condition."""

    def __init__(self, left: Relation, right: Relation):
        self.left, self.right = left, right

    def __getitem__(self, name: str) -> Expr:
        return self.left[name] if name in self.left.types else self.right[name]


def _wide(t: Type, *own: Type) -> S.DataType:
    """Spark's type for a unified one: an unspecified decimal gets the largest scale that it is made of."""
    if t.kind == "decimal" and t.scale is None:
        scales = [x.scale if x.scale is not None else 10 for x in map(T._as_decimal, (o for o in own if o.category is Category.NUMBER))]
        return S.DecimalType(38, max(scales, default=10))
    if t.kind == "decimal" and t.precision is None:
        return S.DecimalType(38, t.scale)
    return T.to_spark(t)
