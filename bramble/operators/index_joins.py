"""Joins by an index: keys are checked against it, and the join is laid out as an equi-join or by bins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from ..catalog import Index
from ..diagnostics import Code, fail
from ..functions.scalar import Expr
from .relation import Relation


def _checked(left: Relation, index: Index, feature: str, gate: str, runtime: str) -> list[str]:
    left.gates.check(gate)
    if runtime not in left.gates.runtime:
        raise fail(Code.UNSUPPORTED_FEATURE, f"the runtime has no {runtime}")
    if feature not in index.features:
        raise fail(Code.UNSUPPORTED_FEATURE, f"{index.name} can't {feature}")
    return [k for k, _ in index.keys]


def join_find(left: Relation, source: Relation, index: Index, keys: dict[str, str], kind: str = "inner", condition: Callable[[Relation], Expr] | None = None) -> Relation:
    """Rows with what an index finds for them. keys: the index's keys, all of them, to columns of the left side."""
    own = _checked(left, index, "find", "relation_join_find", "index_join")
    if set(keys) != set(own):
        raise fail(Code.INCONSISTENT_ELEMENTS, f"{index.name} is found by {own}")
    return left.join(source, kind, [(keys[k], k) for k in own], condition)


def join_scan(left: Relation, source: Relation, index: Index, prefix: dict[str, str], lower: tuple[str, str] | None = None, upper: tuple[str, str] | None = None, kind: str = "inner", condition: Callable[[Relation], Expr] | None = None) -> Relation:
    """Rows with a range of an index: equality on a prefix of its keys, and bounds (">" or ">=", "<" or "<=", with a left column) on the next."""
    own = _checked(left, index, "scan", "relation_join_scan", "index_join_scan")
    if set(prefix) != set(own[: len(prefix)]) or (lower or upper) and len(prefix) == len(own):
        raise fail(Code.INCONSISTENT_ELEMENTS, f"{index.name} is scanned by a prefix of {own} and the next key")
    swapped = {">": "<", ">=": "<=", "<": ">", "<=": ">="}
    terms: Sequence[tuple[str, str, str]] = [(column, swapped[op], own[len(prefix)]) for op, column in (b for b in (lower, upper) if b)]
    return left.join(source, kind, [(prefix[k], k) for k in own[: len(prefix)]], condition, lower=terms)
