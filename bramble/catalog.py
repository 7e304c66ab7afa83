"""The catalog: what Spark's own catalog doesn't know about tables.

Schemas hold tables and views, variables, functions, aggregates and types; providers look
names up in their parent when they don't know them. Indices, sequences and privileges
are records here; Spark's files stay what they are.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Generic, TypeVar

from .diagnostics import Code, fail
from .types import INT4, INT8, Type

V = TypeVar("V")

COLUMN_FEATURES = ("synthesized", "hidden", "read_only")
INDEX_FEATURES = ("primary", "find", "scan", "unique", "unique_constraint")
PRIVILEGES = ("select", "insert", "update", "delete", "control")


class Provider(Generic[V]):
    """Names to elements, with an optional parent that is asked for what isn't here."""

    def __init__(self, parent: Provider[V] | None = None):
        self.parent, self._own = parent, {}

    def find(self, name: str) -> V | None:
        if name in self._own:
            return self._own[name]
        return self.parent.find(name) if self.parent else None

    def add(self, name: str, element: V, overwrite: bool = False) -> V:
        if not overwrite and name in self._own:
            raise ValueError(f"{name} exists already")
        self._own[name] = element
        return element

    def remove(self, name: str) -> bool:
        return self._own.pop(name, None) is not None

    def each(self) -> Iterator[tuple[str, V]]:
        """Own elements, then those of parents that aren't hidden by them."""
        yield from self._own.items()
        if self.parent:
            yield from ((k, v) for k, v in self.parent.each() if k not in self._own)


@dataclass(frozen=True)
class Default:
    """A column's default: an immediate value, a call of a nullary function, or the next value of a sequence."""

    kind: str = "nothing"  # nothing, immediate, function, sequence
    value: Any = None


@dataclass(frozen=True)
class Column:
    name: str
    type: Type
    nullable: bool = True
    default: Default = Default()
    features: frozenset = frozenset()
    #: A predicate or constant that all values satisfy, as SQL text; checked on writing.
    invariant: str | None = None

    @property
    def hidden(self) -> bool:
        return "hidden" in self.features


@dataclass
class Table:
    name: str
    columns: list[Column]
    id: int | None = None
    view_sql: str | None = None

    @property
    def kind(self) -> str:
        return "view" if self.view_sql else "table"

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise fail(Code.UNRESOLVED_VARIABLE, f"{self.name} has no column {name}")

    def visible(self) -> list[Column]:
        return [c for c in self.columns if not c.hidden]


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    keys: tuple[tuple[str, str], ...]  # (column, asc or desc)
    values: tuple[str, ...] = ()
    features: frozenset = frozenset({"find", "scan"})

    @property
    def covers(self) -> set[str]:
        return {k for k, _ in self.keys} | set(self.values)


class Sequence:
    """A generator of 64-bit integers; blocks are reserved on the driver and dealt out to rows there."""

    def __init__(self, name: str, initial: int = 0, increment: int = 1, minimum: int = 0, maximum: int = (1 << 63) - 1, cycle: bool = True):
        if increment == 0 or not minimum <= initial <= maximum:
            raise fail(Code.INCONSISTENT_ELEMENTS, f"sequence {name} has no valid range")
        self.name, self.initial, self.increment, self.minimum, self.maximum, self.cycle = name, initial, increment, minimum, maximum, cycle
        self._next, self._lock = initial, threading.Lock()

    def _step(self, value: int, n: int) -> int:
        """The value n steps on: past its end a sequence goes on from its other end, or fails."""
        span = (self.maximum - self.minimum) // abs(self.increment) + 1
        start = self.minimum if self.increment > 0 else self.maximum
        to = value + n * self.increment
        if self.minimum <= to <= self.maximum:
            return to
        if not self.cycle:
            raise OverflowError(f"sequence {self.name} is exhausted")
        room = (self.maximum - value) // self.increment if self.increment > 0 else (value - self.minimum) // -self.increment
        return start + (n - room - 1) % span * self.increment

    def reserve(self, n: int) -> Block:
        """The next n values."""
        with self._lock:
            first = self._next
            if n:
                if not self.cycle:
                    self._step(first, n - 1)
                try:
                    self._next = self._step(first, n)
                except OverflowError:
                    self._next = self.maximum + 1 if self.increment > 0 else self.minimum - 1
            return Block(self, first, n)

    def next(self) -> int:
        if not self.minimum <= self._next <= self.maximum:
            raise OverflowError(f"sequence {self.name} is exhausted")
        return self.reserve(1).first

    def restart(self) -> None:
        with self._lock:
            self._next = self.initial


@dataclass(frozen=True)
class Block:
    """Reserved values of a sequence."""

    sequence: Sequence
    first: int
    count: int

    def value(self, nth):
        """The value for row number `nth`, a Spark column that counts from 0."""
        from pyspark.sql import functions as F

        s = self.sequence
        room = (s.maximum - self.first) // s.increment if s.increment > 0 else (self.first - s.minimum) // -s.increment
        span = (s.maximum - s.minimum) // abs(s.increment) + 1
        start = s.minimum if s.increment > 0 else s.maximum
        straight = F.lit(self.first) + nth * F.lit(s.increment)
        if self.count <= room + 1:
            return straight
        wrapped = F.lit(start) + F.pmod(nth - F.lit(room + 1), F.lit(span)) * F.lit(s.increment)
        return F.when(nth <= room, straight).otherwise(wrapped)


@dataclass(frozen=True)
class Function:
    """A scalar function (body: columns to a column), or a table-valued one (returns: a table type; body: a Spark UDTF's name)."""

    name: str
    parameters: tuple[Type, ...]
    returns: Type
    body: Callable | str | None = None
    id: int = 20_000

    @property
    def table_valued(self) -> bool:
        return self.returns.kind == "table"


@dataclass(frozen=True)
class Aggregate:
    """An aggregate; incremental if partial results can be combined in any order."""

    name: str
    parameters: tuple[Type, ...]
    returns: Type
    body: Callable
    incremental: bool = True
    id: int = 20_000


@dataclass(frozen=True)
class Variable:
    """A host variable, with the value that it stands for."""

    name: str
    type: Type
    value: Any = None
    nullable: bool = True


@dataclass
class Schema:
    name: str
    storage: Provider[Table] = field(default_factory=Provider)
    indices: Provider[Index] = field(default_factory=Provider)
    sequences: Provider[Sequence] = field(default_factory=Provider)
    variables: Provider[Variable] = field(default_factory=Provider)
    functions: Provider[list] = field(default_factory=Provider)
    aggregates: Provider[list] = field(default_factory=Provider)
    types: Provider[Type] = field(default_factory=Provider)

    def indices_of(self, table: str) -> list[Index]:
        return [i for _, i in self.indices.each() if i.table == table]

    def primary_index(self, table: str) -> Index | None:
        return next((i for i in self.indices_of(table) if "primary" in i.features), None)


class Catalog:
    """Schemas by name, a search path of schemas, and privileges."""

    def __init__(self, name: str = "main"):
        self.name, self.schemas = name, Provider()
        self.path: list[str] = []
        self._grants: dict[tuple[str, str], set[str]] = {}

    def add_schema(self, schema: Schema, search: bool = True) -> Schema:
        self.schemas.add(schema.name, schema)
        if search:
            self.path.append(schema.name)
        return schema

    def _searched(self) -> Iterator[Schema]:
        yield from (s for n in self.path if (s := self.schemas.find(n)))

    def find(self, provider: str, name: str):
        """The first element of a name in the search path; `schema.name` looks in that schema alone."""
        if "." in name:
            schema, _, name = name.partition(".")
            found = self.schemas.find(schema)
            return getattr(found, provider).find(name) if found else None
        return next((x for s in self._searched() if (x := getattr(s, provider).find(name)) is not None), None)

    def overloads(self, provider: str, name: str) -> list:
        """All functions or aggregates of a name, in the order of the search path."""
        return [f for s in self._searched() for f in getattr(s, provider).find(name) or []]

    def owner(self, table: str) -> Schema:
        for s in self._searched():
            if s.storage.find(table) is not None:
                return s
        raise fail(Code.UNRESOLVED_VARIABLE, f"there is no table {table}")

    def table(self, name: str) -> Table:
        found = self.find("storage", name)
        if found is None:
            raise fail(Code.UNRESOLVED_VARIABLE, f"there is no table {name}")
        return found

    # Privileges

    def grant(self, table: str, user: str, privileges: set[str]) -> None:
        self.table(table)
        if unknown := privileges - set(PRIVILEGES):
            raise fail(Code.INCONSISTENT_ELEMENTS, f"there are no privileges {sorted(unknown)}")
        self._grants.setdefault((table, user), set()).update(privileges)

    def revoke(self, table: str, user: str, privileges: set[str]) -> None:
        self.table(table)
        self._grants.get((table, user), set()).difference_update(privileges)

    def allowed(self, table: str, user: str, privilege: str) -> bool:
        own = self._grants.get((table, user), set()) | self._grants.get((table, "*"), set())
        return privilege in own or "control" in own


def check_default(column: Column, catalog: Catalog) -> None:
    """A default must be assignable to its column; sequences need int4 or int8, functions must be scalar and nullary."""
    from .functions.scalar import literal
    from .types import assignable

    d = column.default
    if d.kind == "immediate":
        if not assignable(literal(d.value).type, column.type):
            raise fail(Code.INCONSISTENT_TYPE, f"the default of {column.name} can't be of {column.type}")
    elif d.kind == "sequence":
        if catalog.find("sequences", d.value) is None:
            raise fail(Code.UNRESOLVED_VARIABLE, f"there is no sequence {d.value}")
        if column.type not in (INT4, INT8):
            raise fail(Code.INCONSISTENT_TYPE, f"{column.name} must be int4 or int8 to have a sequence")
    elif d.kind == "function":
        found = [f for f in catalog.overloads("functions", d.value) if not f.parameters]
        if not found:
            raise fail(Code.UNRESOLVED_VARIABLE, f"there is no function {d.value}()")
        if found[0].table_valued:
            raise fail(Code.INCONSISTENT_FUNCTION_TYPE, f"{d.value} is not a scalar function")
        if not assignable(found[0].returns, column.type):
            raise fail(Code.INCONSISTENT_TYPE, f"{d.value}() can't be assigned to {column.name}")
    elif d.kind != "nothing":
        raise fail(Code.INCONSISTENT_ELEMENTS, f"{d.kind} is no kind of default")
