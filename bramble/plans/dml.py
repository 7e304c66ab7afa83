"""Data changes as copy-on-write: the table's next content as a DataFrame, and its atomic replacement."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import types as T
from ..catalog import Catalog, Column, Table
from ..diagnostics import Code, fail
from ..functions.registry import call
from ..functions.scalar import assign, expr
from ..operators.relation import Relation
from ..sources import commits
from .gates import Gates

WRITE_KINDS = ("insert", "insert_overwrite", "insert_skip", "update", "delete")


def check_mapping(table: Table, source: Relation, mapping: Mapping[str, str]) -> dict[str, Any]:
    """Source columns as values of table columns, each assignable."""
    out = {}
    for column, name in mapping.items():
        c = table.column(column)
        if "read_only" in c.features:
            raise fail(Code.INCONSISTENT_ELEMENTS, f"{column} can't be written")
        out[column] = assign(source[name], c.type)
    return out


def insert_rows(catalog: Catalog, table: Table, source: Relation, mapping: Mapping[str, str]) -> DataFrame:
    """Rows to insert: mapped columns, and defaults for the others.

    Values of sequences go to rows in the order of the mapped columns; a block of them is
    reserved with one count, and numbers are dealt by partition offsets, not through one task.
    """
    given = check_mapping(table, source, mapping)
    df = source.df.select(*[e.column.alias(c) for c, e in given.items()])
    sequences = [c for c in table.columns if c.name not in given and c.default.kind == "sequence"]
    if sequences:
        df, n = numbered(df, "__nth")
        blocks = {c.name: catalog.find("sequences", c.default.value).reserve(n) for c in sequences}
    columns = []
    for c in table.columns:
        spark = T.to_spark(c.type)
        if c.name in given:
            columns.append(F.col(c.name))
        elif c.default.kind == "immediate":
            columns.append(assign(c.default.value, c.type).column.alias(c.name))
        elif c.default.kind == "function":
            columns.append(assign(call(catalog, c.default.value), c.type).column.alias(c.name))
        elif c.default.kind == "sequence":
            columns.append(blocks[c.name].value(F.col("__nth")).cast(spark).alias(c.name))
        elif c.nullable:
            columns.append(F.lit(None).cast(spark).alias(c.name))
        else:
            raise fail(Code.INCONSISTENT_ELEMENTS, f"{c.name} has neither a value nor a default")
    return checked(df.select(*columns), table)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Number rows from 0 in the order of all columns: ranges are sorted apart, and their sizes give the offsets."""
    keys = [F.col(c).asc_nulls_first() for c in df.columns]
    part = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    part = part.checkpoint() if part.sparkSession.sparkContext.getCheckpointDir() else part  # both passes see the same numbers, whatever executor is lost
    held = part.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__base", F.coalesce(F.sum("__size").over(before), F.lit(0))).select("__part", "__base", "__size")  # a row for each partition
    rows = {r["__part"]: (r["__base"], r["__size"]) for r in offsets.collect()}
    base = F.element_at(F.create_map(*[x for k, (b, _) in rows.items() for x in (F.lit(k), F.lit(b))]), F.col("__part")) if rows else F.lit(0)
    return held.withColumn(name, base + F.col("__at")).drop("__id", "__part", "__at"), sum(n for _, n in rows.values())


def checked(df: DataFrame, table: Table) -> DataFrame:
    """NOT NULL columns and invariants are enforced when rows are written."""
    for c in table.columns:
        if not c.nullable:
            df = df.withColumn(c.name, F.coalesce(F.col(c.name), F.raise_error(F.lit(f"{c.name} must not be null")).cast(T.to_spark(c.type))))
        if c.invariant:
            df = df.withColumn(c.name, F.when(F.coalesce(F.expr(c.invariant), F.lit(True)), F.col(c.name)).otherwise(F.raise_error(F.lit(f"{c.name} must satisfy {c.invariant}")).cast(T.to_spark(c.type))))
    return df


def insert(old: DataFrame, new: DataFrame, keys: Sequence[str] = (), unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Old and new rows; with keys a row whose key exists (or comes twice) is an error, and so it is for other unique keys, in which nulls differ from each other.

    Only keys move, and old rows not at all: new keys are counted, and those that are there already found.
    """
    both = old.unionByName(new)
    checks = [(names, new) for names in [keys] if names] + [(names, new.dropna(subset=list(names))) for names in unique]
    for names, rows in checks:
        named = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in names]).agg(F.count("*").alias("__n"))
        on = None
        for k in names:
            term = F.col(k).eqNullSafe(F.col(f"__{k}"))
            on = term if on is None else on & term
        there = old.select(*names).join(named, on, "left_semi").select(F.lit(1).alias("__bad"))
        bad = named.where("__n > 1").select(F.lit(1).alias("__bad")).unionAll(there).agg(F.count("*").alias("__bad"))  # one row
        ok = F.when(F.col("__bad") > 0, F.raise_error(F.lit(f"duplicate key in {', '.join(names)}")).cast("boolean")).otherwise(F.lit(True))
        both = both.crossJoin(F.broadcast(bad)).where(ok).select(old.columns)
    return both


def _one_each(new: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in new.columns]
    return new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def insert_overwrite(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows take the place of old ones of the same key. Of new rows with one key, the first in order counts."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(old.columns).unionByName(_one_each(new, keys))


def insert_skip(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows of which the key is there already stay away."""
    return old.unionByName(_one_each(new, keys).join(old.select(*keys), list(keys), "left_anti").select(old.columns))


def update(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set the columns of `changes` in rows with its keys; null is a value like others."""
    set_ = [c for c in changes.columns if c not in keys]
    right = _one_each(changes, keys).select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__v_{c}") for c in set_], F.lit(True).alias("__hit"))
    on = [old[k] == right[f"__k_{k}"] for k in keys]
    joined = old.join(right, on, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__v_{c}")).otherwise(old[c]).alias(c) if c in set_ else old[c] for c in old.columns])


def update_where(relation: Relation, condition, **values) -> Relation:
    """UPDATE with expressions over the row: SET column = expression WHERE condition."""
    relation.gates.check("statement_write_update")
    where = expr(condition(relation) if callable(condition) and not hasattr(condition, "column") else condition).column
    df = relation.df
    columns = []
    for c in relation.columns:
        if c in values:
            new = assign(relation._expr(values[c]), relation.types[c])
            columns.append(F.when(F.coalesce(where, F.lit(False)), new.column).otherwise(df[c]).alias(c))
        else:
            columns.append(df[c])
    if unknown := set(values) - set(relation.columns):
        raise fail(Code.UNRESOLVED_VARIABLE, f"there are no columns {sorted(unknown)}")
    return relation._of(df.select(*columns), relation.types)


def delete(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't in `gone`."""
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(old.columns)


def delete_where(relation: Relation, condition) -> Relation:
    relation.gates.check("statement_write_delete")
    where = expr(condition(relation)).column
    return relation._of(relation.df.where(~F.coalesce(where, F.lit(False))), relation.types)


def write(catalog: Catalog, table: Table, old: DataFrame, source: Relation, kind: str, mapping: Mapping[str, str], gates: Gates | None = None) -> DataFrame:
    """The table's content after a write; keys are those of its primary index."""
    if kind not in WRITE_KINDS:
        raise fail(Code.UNSUPPORTED_FEATURE, f"there is no write of kind {kind}")
    gates = gates or Gates()
    if kind.startswith("insert"):
        gates.check("relation_write_insert")
    if kind in ("update", "delete"):
        gates.check(f"statement_write_{kind}")
    index = catalog.owner(table.name).primary_index(table.name)
    keys = [k for k, _ in index.keys] if index else []
    if kind != "insert" and not keys:
        raise fail(Code.INCONSISTENT_ELEMENTS, f"{table.name} has no primary index")
    if kind == "insert":
        unique = [[k for k, _ in i.keys] for i in catalog.owner(table.name).indices_of(table.name) if "unique_constraint" in i.features]
        return insert(old, insert_rows(catalog, table, source, mapping), keys, unique)
    if kind in ("insert_overwrite", "insert_skip"):
        return (insert_overwrite if kind == "insert_overwrite" else insert_skip)(old, insert_rows(catalog, table, source, mapping), keys)
    if missing := [k for k in keys if k not in mapping]:
        raise fail(Code.INCONSISTENT_ELEMENTS, f"keys {missing} are missing")
    given = check_mapping(table, source, mapping)
    rows = source.df.select(*[e.column.alias(c) for c, e in given.items()])
    return update(old, rows, keys) if kind == "update" else delete(old, rows, keys)


def replace(spark: SparkSession, df: DataFrame, path: str, base: int | None = None) -> int:
    """Write a table's next content as a version of its own and commit it; returns the version.

    Readers see the version they began with or the new one, never none; of two writers from
    one version the second gets a ConflictError. `base` is the version that `df` was made
    from, the latest by default. The version before the last stays for its readers.
    """
    folder = path.rstrip("/")
    base = max(commits.versions(spark, f"{folder}/_versions"), default=0) if base is None else base
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    commits.commit(spark, f"{folder}/_versions", base + 1, {"data": name})
    for old in commits.versions(spark, f"{folder}/_versions")[:-2]:
        at = commits.path_of(f"{folder}/_versions", old)
        gone = commits.read_json(spark, at)["data"]
        for x in (at, f"{folder}/{gone}"):  # a version goes before its rows
            fs, p = commits.file_system(spark, x)
            fs.delete(p, True)
    return base + 1


def current(spark: SparkSession, path: str) -> DataFrame:
    """A table's content in its latest version."""
    folder = path.rstrip("/")
    last = commits.versions(spark, f"{folder}/_versions")
    if not last:
        return spark.read.parquet(folder)
    return spark.read.parquet(f"{folder}/{commits.read_json(spark, commits.path_of(f'{folder}/_versions', last[-1]))['data']}")


def literal_rows(spark: SparkSession, table: Table, columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> Relation:
    """Tuples of a write statement, each cell assignable to its column."""
    from ..sources.tables import values

    for row in rows:
        if len(row) > len(columns):
            raise fail(Code.INCONSISTENT_ELEMENTS, "too many values")
        if len(row) < len(columns):
            raise fail(Code.INCONSISTENT_ELEMENTS, "too short values")
    cells = [[assign(v, table.column(c).type) for c, v in zip(columns, row, strict=True)] for row in rows]
    return values(spark, columns, cells)


def empty_table(spark: SparkSession, columns: Sequence[Column]) -> DataFrame:
    from pyspark.sql import types as S

    return spark.createDataFrame([], S.StructType([S.StructField(c.name, T.to_spark(c.type)) for c in columns]))
