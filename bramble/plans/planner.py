"""What Catalyst doesn't do by itself: range hints from disjunctions, index choice, and a look at plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..catalog import Index
from ..functions.scalar import Expr, compare
from ..operators.relation import Relation

#: Assumed selectivity of a key that is equal, bounded on both sides, or on one.
EQUAL, BOUNDED, HALF_BOUNDED = 0.1, 0.3, 0.6
#: What uniqueness does to selectivity, and an index that covers all columns to a score.
UNIQUE_FACTOR, INDEX_ONLY_FACTOR = 0.125, 2.0


@dataclass(frozen=True)
class Term:
    """column op value; or a conjunction (`all`) or disjunction (`any`) of terms."""

    column: str = ""
    op: str = "="
    value: Any = None
    all: tuple[Term, ...] = ()
    any: tuple[Term, ...] = ()

    def expr(self, relation: Relation) -> Expr:
        if self.all or self.any:
            out = None
            for t in self.all or self.any:
                e = t.expr(relation)
                out = e if out is None else out & e if self.all else out | e
            return out
        return compare(self.op, relation[self.column], self.value)


def ranges(term: Term) -> dict[str, tuple[Any, Any]]:
    """For each column the least and largest value that the term allows; None where it sets no end."""
    if term.all:
        out: dict[str, tuple[Any, Any]] = {}
        for t in term.all:
            for c, (lo, hi) in ranges(t).items():
                a, b = out.get(c, (None, None))
                out[c] = (lo if a is None else a if lo is None else max(a, lo), hi if b is None else b if hi is None else min(b, hi))
        return out
    if term.any:
        parts = [ranges(t) for t in term.any]
        shared = set(parts[0]).intersection(*parts[1:])
        out = {}
        for c in shared:
            los, his = [p[c][0] for p in parts], [p[c][1] for p in parts]
            out[c] = (None if None in los else min(los), None if None in his else max(his))
        return {c: r for c, r in out.items() if r != (None, None)}
    if term.op == "=":
        return {term.column: (term.value, term.value)}
    if term.op in ("<", "<="):
        return {term.column: (None, term.value)}
    if term.op in (">", ">="):
        return {term.column: (term.value, None)}
    return {}


def filter_with_range_hint(relation: Relation, term: Term) -> Relation:
    """A filter by a disjunction, with the column ranges that follow from it: these reach row-group statistics."""
    out = term.expr(relation)
    for column, (lo, hi) in ranges(term).items():
        if lo is not None:
            out = out & compare(">=", relation[column], lo)
        if hi is not None:
            out = out & compare("<=", relation[column], hi)
    return relation.filter(out)


@dataclass(frozen=True)
class IndexScore:
    index: Index
    score: float
    attributes: frozenset


def estimate_index(index: Index, terms: Mapping[str, str], columns: Sequence[str], sort: Sequence[tuple[str, str]] = ()) -> IndexScore:
    """Score an index for terms (column: equal, bounded or half): keys count up to the first that isn't equal."""
    selectivity, used, equal = 1.0, 0, 0
    for name, _ in index.keys:
        kind = terms.get(name)
        if kind is None:
            break
        selectivity *= {"equal": EQUAL, "bounded": BOUNDED, "half": HALF_BOUNDED}[kind]
        used += 1
        if kind != "equal":
            break
        equal += 1
    attributes = set()
    whole = equal == len(index.keys) and equal > 0
    if whole and "find" in index.features:
        attributes.add("find")
    elif used and "scan" in index.features:
        attributes.add("range_scan")
    if whole and index.features & {"primary", "unique"}:
        selectivity *= UNIQUE_FACTOR
        attributes.add("single_row")
    covers = set(columns) <= index.covers
    if covers:
        attributes.add("index_only")
    if sort and tuple(sort) == index.keys[equal : equal + len(sort)]:
        attributes.add("sorted")
    return IndexScore(index, 1.0 / selectivity * (INDEX_ONLY_FACTOR if covers else 1.0), frozenset(attributes))


def choose_index(indices: Sequence[Index], terms: Mapping[str, str], columns: Sequence[str], sort: Sequence[tuple[str, str]] = ()) -> IndexScore | None:
    """The index of the best score; the first of several."""
    scored = [estimate_index(i, terms, columns, sort) for i in indices if i.features & {"find", "scan"}]
    return max(scored, key=lambda s: s.score, default=None)


def sort_for_index(df: DataFrame, index: Index) -> DataFrame:
    """A copy in the index's order: row groups then have narrow ranges of its keys, which scans skip by."""
    keys = [df[c].desc() if d == "desc" else df[c].asc() for c, d in index.keys]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def plan_json(df: DataFrame) -> str:
    """The optimised logical plan as JSON."""
    return df._jdf.queryExecution().optimizedPlan().toJSON()
