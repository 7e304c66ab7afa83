"""Exchanges of a step plan, where a caller wants to place them by hand. Usually Catalyst does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from .. import types as T
from ..diagnostics import Code, fail
from .relation import Aggregation, Relation, _wide
from .strategies import broadcast_if_small


def forward(relation: Relation, limit: int | None = None) -> Relation:
    """Rows as they come, at most `limit` of them."""
    relation.gates.check("exchange_forward")
    return relation if limit is None else relation.limit(limit)


def group(relation: Relation, keys: Sequence[str], sort: Sequence[str | tuple[str, str]] = (), limit: int | None = None, or_whole: bool = False) -> Relation:
    """Rows of a key together, in order; at most `limit` of each. Without keys all rows are one group, if `or_whole` says so."""
    relation.gates.check("exchange_group")
    if not keys:
        if not or_whole:
            raise fail(Code.INCONSISTENT_ELEMENTS, "a group needs a key")
        return relation.limit(limit, sort=sort)
    return relation.limit(limit, keys, sort)


def aggregate(relation: Relation, keys: Sequence[str], **columns: Aggregation) -> Relation:
    """Groups combined before and after they move."""
    return relation.aggregate(keys, **columns)


def broadcast(relation: Relation) -> Relation:
    """All rows to every task, if Spark's estimate bears out that they are few."""
    relation.gates.check("exchange_broadcast")
    return Relation(broadcast_if_small(relation.df), relation.types, relation.gates, relation.catalog)


def discard(relation: Relation) -> None:
    """Run a plan and keep nothing."""
    relation.gates.check("exchange_discard")
    relation.df.write.format("noop").mode("overwrite").save()


def offer(*relations: Relation) -> Relation:
    """Several producers of one exchange: their rows together, with unified types."""
    out = relations[0]
    for r in relations[1:]:
        out = out.union(r)
    return out


def take_flat(exchanged: Relation, *columns: str) -> Relation:
    """Rows of an exchange as they come: these columns, or all."""
    return exchanged.select(*(columns or exchanged.columns))


def _grouped(relation: Relation, keys: Sequence[str], columns: Sequence[str], sort: Sequence[str | tuple[str, str]], name: str, by: Sequence[str]) -> Relation:
    """A row for each key, with an array of its rows in the order of `sort` (of all their columns beyond that)."""
    for s in sort:
        relation._key(s if isinstance(s, str) else s[0], True, "GROUP")
    if any(not isinstance(s, str) and s[1] == "desc" for s in sort):
        raise fail(Code.UNSUPPORTED_FEATURE, "groups are sorted upwards")
    order = [s if isinstance(s, str) else s[0] for s in sort]
    first = [c for c in order if c in columns]
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in [*first, *(c for c in columns if c not in first)]])))
    rows = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    kind = T.array(T.record(**{c: relation.types[c] for c in columns}))
    df = relation.df.groupBy(*[relation.df[k].alias(b) for k, b in zip(keys, by, strict=True)]).agg(rows.alias(name))
    return relation._of(df, {b: relation.types[k] for k, b in zip(keys, by, strict=True)} | {name: kind})


def take_group(exchanged: Relation, keys: Sequence[str], columns: Sequence[str] | None = None, sort: Sequence[str] = (), name: str = "group") -> Relation:
    """A row for each key (nulls are equal), with its rows as an array. A group must fit a task's memory."""
    for k in keys:
        exchanged._key(k, False, "GROUP")
    return _grouped(exchanged, keys, columns or [c for c in exchanged.columns if c not in keys], sort, name, keys)


def take_cogroup(sides: Sequence[tuple[Relation, Sequence[str], bool]], names: Sequence[str], sort: Sequence[str] = ()) -> Relation:
    """Groups of several exchanges with one key: (relation, keys, mandatory) for each side.

    Columns: the keys of the first side, in types that all sides' keys unify to, and for each
    side an array of its other columns' rows, empty where it has none. Keys without rows of
    a mandatory side are left out; nulls are equal. A group must fit a task's memory.
    """
    first, keys, _ = sides[0]
    types, spark = {}, {}
    for i, k in enumerate(keys):
        own = [r._key(by[i], False, "CO-GROUP").type for r, by, _ in sides]
        types[k] = T.unify_all(own)
        if types[k] == T.ERROR:
            raise fail(Code.INCONSISTENT_TYPE, f"{k} can't be of " + " and ".join(map(str, own)))
        spark[k] = _wide(types[k], *own)
    out = None
    for (relation, by, _), name in zip(sides, names, strict=True):
        held = relation._of(relation.df.withColumns({f"__{k}": relation.df[b].cast(spark[k]) for k, b in zip(keys, by, strict=True)}), relation.types | {f"__{k}": types[k] for k in keys})
        one = _grouped(held, [f"__{k}" for k in keys], [c for c in relation.columns if c not in by], [s for s in sort if s in relation.types], name, [f"__{k}" for k in keys])
        if out is None:
            out = one
            continue
        left, right = out.df, one.df.withColumnsRenamed({f"__{k}": f"__r_{k}" for k in keys})
        on = None
        for k in keys:
            term = left[f"__{k}"].eqNullSafe(right[f"__r_{k}"])
            on = term if on is None else on & term
        joined = left.withColumn("__left", F.lit(True)).join(right, on, "full")
        merged = [F.when(F.col("__left"), F.col(f"__{k}")).otherwise(F.col(f"__r_{k}")).alias(f"__{k}") for k in keys]
        out = relation._of(joined.select(*merged, *[F.col(n) for n in list(out.types)[len(keys):]], F.col(name)), out.types | {name: one.types[name]})
    df = out.df
    for (_, _, mandatory), name in zip(sides, names, strict=True):
        df = df.where(F.col(name).isNotNull()) if mandatory else df.withColumn(name, F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)))
    return first._of(df.select(*[F.col(f"__{k}").alias(k) for k in keys], *names), types | {n: out.types[n] for n in names})


def flatten(groups: Relation, name: str = "group") -> Relation:
    """Groups as rows again: a row for each member of the array, beside the other columns."""
    groups.gates.check("relation_flatten")
    kind = groups.types.get(name)
    if kind is None or kind.kind != "array":
        raise fail(Code.INCONSISTENT_TYPE, f"{name} isn't a group")
    rest = [c for c in groups.columns if c != name]
    fields = dict(kind.elements[0].elements)
    made = groups.df.select(*rest, F.explode(name).alias("__row"))
    return groups._of(made.select(*rest, *[F.col("__row")[c].alias(c) for c in fields]), {c: groups.types[c] for c in rest} | fields)
