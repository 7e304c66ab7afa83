"""A session: a catalog over a SparkSession, statements, and inspection without running anything."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from dataclasses import replace as dataclass_replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types as T
from .catalog import Catalog, Column, Index, Schema, Table, check_default
from .diagnostics import Code, CompileError, Diagnostic, fail
from .functions.registry import standard_aggregates
from .functions.scalar import Expr, literal
from .operators.relation import Relation
from .plans import dml
from .plans.gates import Gates, Options
from .plans.planner import Term, filter_with_range_hint


@dataclass
class Inspection:
    """Types of a relation's columns, or what is wrong with it."""

    types: dict[str, T.Type] = field(default_factory=dict)
    diagnostics: list[Diagnostic] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.diagnostics


class Session:
    """Tables live as Parquet under `path`, or as frames that were registered; changes are copy-on-write."""

    def __init__(self, spark: SparkSession, path: str | None = None, catalog: Catalog | None = None, gates: Gates | None = None, user: str | None = None, options: Options | None = None):
        self.options = options or Options()
        self.path, self.gates, self.user = path, gates or Gates(), user
        settings = {"spark.sql.timeType.enabled": "true"} | self.gates.spark_conf()
        if any(spark.conf.get(k, None) != v for k, v in settings.items()):  # the caller's session stays as it is
            spark = spark.newSession()
            for k, v in settings.items():
                spark.conf.set(k, v)
        self.spark = spark
        self.catalog = catalog or Catalog()
        if catalog is None:
            self.catalog.add_schema(Schema("public"))
            standard_aggregates(self.catalog.add_schema(Schema("builtin")))
        self._frames: dict[str, DataFrame] = {}

    # Relations

    def register(self, name: str, df: DataFrame, types: dict[str, T.Type] | None = None, primary: Sequence[str] = ()) -> Relation:
        """Make a DataFrame a table of the catalog."""
        relation = Relation(df, types, self.gates, self.catalog)
        schema = self.catalog.schemas.find(self.catalog.path[0])
        fields = {f.name: f for f in df.schema.fields}
        schema.storage.add(name, Table(name, [Column(c, t, fields[c].nullable) for c, t in relation.types.items()]), overwrite=True)
        if primary:
            schema.indices.add(f"{name}_primary", Index(f"{name}_primary", name, tuple((k, "asc") for k in primary), features=frozenset({"primary", "find", "scan", "unique"})), overwrite=True)
        self._frames[name] = df
        return relation

    def _need(self, table: str, privilege: str) -> None:
        if self.user is not None and not self.catalog.allowed(table, self.user, privilege):
            raise PermissionError(f"{self.user} may not {privilege} on {table}")

    def _frame(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        table = self.catalog.table(name)
        if table.view_sql:
            return self.spark.sql(table.view_sql)
        return dml.current(self.spark, f"{self.path}/{name}")

    def table(self, name: str, hidden: bool = False) -> Relation:
        """A table's relation, without its hidden columns."""
        found = self.catalog.table(name)
        self._need(name, "select")
        relation = Relation(self._frame(name), {c.name: c.type for c in found.columns}, self.gates, self.catalog)
        return relation if hidden else relation.select(*[c.name for c in found.visible()])

    def variable(self, name: str) -> Expr:
        """A host variable: a named parameter with a value."""
        found = self.catalog.find("variables", name)
        if found is None:
            raise fail(Code.UNRESOLVED_VARIABLE, f"there is no variable {name}")
        value = literal(found.value, found.type)
        if self.options.inline_host_variables:
            return value
        # A call that Catalyst can't fold, so that one plan serves for all values of a variable's type.
        return Expr(value.type, F.element_at(F.transform(F.array(F.monotonically_increasing_id()), lambda _: value.column), 1))

    def filter(self, relation: Relation, term: Term) -> Relation:
        """A filter by a term of comparisons, with or without the ranges that follow from its disjunctions."""
        return filter_with_range_hint(relation, term) if self.options.disjunction_range_hint else relation.filter(term.expr(relation))

    def type(self, name: str) -> T.Type:
        """A type by its name in the schemas of the search path."""
        found = self.catalog.find("types", name)
        if found is None:
            raise fail(Code.UNSUPPORTED_TYPE, f"there is no type {name}")
        return found

    def inspect(self, *builds: Callable[[], Any]) -> Inspection:
        """Types of what the last of `builds` returns, and what is wrong with any of them; plans aren't run.

        A build makes a relation or an expression, or is a statement's check. A diagnostic that
        names no region gets the name of the build it comes from.
        """
        out = Inspection()
        for build in builds:
            try:
                made = build()
            except CompileError as e:
                out.diagnostics += [d if d.region else dataclass_replace(d, region=getattr(build, "__name__", "").strip("<>")) for d in e.diagnostics]
                continue
            out.types = made.types if isinstance(made, Relation) else {"": made.type} if isinstance(made, Expr) else {}
        if out.diagnostics:
            out.types = {}
        return out

    # Statements

    def create_table(self, table: Table, primary_key: Sequence[str] = (), unique_keys: Sequence[Sequence[str]] = (), can: Sequence[str] = ("find", "scan")) -> Table:
        """A table with its indices. can: what these are for; keys that are scanned must have an order, others equality alone."""
        schema = self.catalog.schemas.find(self.catalog.path[0])
        if schema.storage.find(table.name) is not None:
            raise fail(Code.INCONSISTENT_ELEMENTS, f"table {table.name} exists already")
        # Names of types stand for what the schemas say.
        table.columns[:] = [dataclass_replace(c, type=self.type(c.type.name)) if c.type.kind == "declared" and not c.type.elements else c for c in table.columns]
        for c in table.columns:
            if c.type.kind in ("unknown", "error", "pending"):
                raise fail(Code.UNSUPPORTED_TYPE, f"{c.name} has no type")
            T.to_spark(c.type)
            check_default(c, self.catalog)
        for keys in [primary_key, *unique_keys]:
            for k in keys:
                t = table.column(k).type
                if not (t.order_comparable if "scan" in can else t.equality_comparable):
                    raise fail(Code.INCONSISTENT_TYPE, f"key {k} of {table.column(k).type} can't be compared")
        schema.storage.add(table.name, table)
        if primary_key:
            schema.indices.add(f"{table.name}_primary", Index(f"{table.name}_primary", table.name, tuple((k, "asc") for k in primary_key), features=frozenset({"primary", "unique", *can})))
        for i, keys in enumerate(unique_keys):
            schema.indices.add(f"{table.name}_unique{i}", Index(f"{table.name}_unique{i}", table.name, tuple((k, "asc") for k in keys), features=frozenset({"unique", "unique_constraint", *can})))
        self._store(table.name, dml.empty_table(self.spark, table.columns))
        return table

    def create_index(self, index: Index) -> Index:
        table = self.catalog.table(index.table)
        for k, _ in index.keys:
            t = table.column(k).type
            if "scan" in index.features and not t.order_comparable or not t.equality_comparable:
                raise fail(Code.INCONSISTENT_TYPE, f"key {k} of {t} can't be compared")
        return self.catalog.owner(index.table).indices.add(index.name, index)

    def drop_table(self, name: str) -> None:
        schema = self.catalog.owner(name)
        for i in schema.indices_of(name):
            schema.indices.remove(i.name)
        schema.storage.remove(name)
        self._frames.pop(name, None)

    def drop_index(self, name: str) -> None:
        if not any(self.catalog.schemas.find(n).indices.remove(name) for n in self.catalog.path):
            raise fail(Code.UNRESOLVED_VARIABLE, f"there is no index {name}")

    def truncate_table(self, name: str, restart_identity: bool = False) -> None:
        self.gates.check("statement_truncate_table")
        if restart_identity:
            self.gates.check("statement_truncate_table_restart_identity")
        self._need(name, "control")
        table = self.catalog.table(name)
        self._store(name, dml.empty_table(self.spark, table.columns))
        for c in table.columns:
            if restart_identity and c.default.kind == "sequence":
                self.catalog.find("sequences", c.default.value).restart()

    def grant(self, table: str, user: str, *privileges: str) -> None:
        self.catalog.grant(table, user, set(privileges))

    def revoke(self, table: str, user: str, *privileges: str) -> None:
        self.catalog.revoke(table, user, set(privileges))

    def write(self, name: str, source: Relation, kind: str, mapping: dict[str, str] | None = None) -> Relation:
        """Insert, overwrite, skip, update or delete by the rows of a relation; returns the table's new content."""
        self._need(name, "insert" if kind.startswith("insert") else kind)
        table = self.catalog.table(name)
        mapping = mapping or {c: c for c in source.columns}
        self._store(name, dml.write(self.catalog, table, self._frame(name), source, kind, mapping, self.gates))
        return Relation(self._frame(name), {c.name: c.type for c in table.columns}, self.gates, self.catalog)

    def write_values(self, name: str, kind: str, columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> Relation:
        """The write statement: tuples of literals."""
        if kind in ("update", "delete"):
            self.gates.check(f"statement_write_{kind}")
        return self.write(name, dml.literal_rows(self.spark, self.catalog.table(name), columns, rows), kind)

    def empty(self) -> None:
        """The empty statement."""

    def execute(self, relation: Relation | DataFrame, discard: bool = False) -> DataFrame | None:
        """Run a plan: its rows, or nothing if they are discarded."""
        df = relation.emit() if isinstance(relation, Relation) else relation
        if not discard:
            return df
        self.gates.check("exchange_discard")
        df.write.format("noop").mode("overwrite").save()
        return None

    def _store(self, name: str, df: DataFrame) -> None:
        if self.path is None:
            self._frames[name] = df
        else:
            dml.replace(self.spark, df, f"{self.path}/{name}")
            self._frames.pop(name, None)
