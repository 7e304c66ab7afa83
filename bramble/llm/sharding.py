"""Sharding with size-tiered compaction and an atomically committed, versioned manifest.

Arrivals are appended as small immutable shards. Compaction merges runs of similar size
into files of the target size; a merge reads its inputs and writes its output without a
shuffle, and many merges go into one Spark job. Readers see exactly the shards of one
manifest version; a version is a file that comes into being by a rename that fails if the
version exists, so of two writers one wins and the other must start again.

A version lists parts, files with up to PART_SHARDS shards each; a commit writes parts for
what it changes, and names those of its parent for the rest.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import commits
from ..sources.commits import ConflictError as ConflictError
from .common import file_system, new_path, table

TARGET_BYTES = 128 << 20
FAN_IN = 4
ARRIVAL_ROWS = 2000
MERGES_A_JOB = 24
PART_SHARDS = 5000
#: What no version names is deleted only after this time: another writer may be about to commit it.
RETENTION_SECONDS = 24 * 3600


def plan_merges(sizes: dict[str, int], target: int, fan_in: int) -> list[list[str]]:
    """Groups of shards to merge: of one size tier (a power of fan_in), up to the target size, at least fan_in of them.

    Shards of half the target or more are left alone. A group that fills the target may
    have fewer than fan_in members, but not one. Each row is rewritten at most once for each tier.
    """
    tiers: dict[int, list[str]] = {}
    for name, size in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        if size < target / 2:
            tiers.setdefault(int(math.log(max(size, 1), fan_in)), []).append(name)
    out: list[list[str]] = []
    for names in tiers.values():
        group, total = [], 0
        for name in names:
            if group and total + sizes[name] > target:
                out.append(group)
                group, total = [], 0
            group.append(name)
            total += sizes[name]
        out.append(group)
    return [g for g in out if len(g) >= fan_in or len(g) > 1 and sum(sizes[x] for x in g) >= target / 2]


class ShardStore:
    """A table of immutable Parquet shards under one path that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return commits.versions(self.spark, f"{self.path}/manifest")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the latest: version, schema, shards with bytes and rows, and the parts that list them."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "shards": {}, "parts": {}}
        found = commits.read_json(self.spark, commits.path_of(f"{self.path}/manifest", have[-1] if version is None else version))
        parts = {name: commits.read_json(self.spark, f"{self.path}/{name}") for name in found["parts"]}
        return found | {"parts": {name: sorted(shards) for name, shards in parts.items()}, "shards": {k: v for shards in parts.values() for k, v in shards.items()}}

    def commit(self, base: dict, shards: dict, schema: str) -> dict:
        """Make `shards` the next version after `base`; ConflictError if another writer was first."""
        kept = {name: own for name, own in base["parts"].items() if all(n in shards for n in own) and (len(own) >= PART_SHARDS // 2 or len(base["parts"]) < 16)}
        listed = {n for own in kept.values() for n in own}
        rest = sorted(n for n in shards if n not in listed)
        parts = dict(kept)
        for at in range(0, len(rest), PART_SHARDS):
            own = rest[at : at + PART_SHARDS]
            name = f"manifest/part-{uuid.uuid4().hex}.json"
            commits.write_json(self.spark, f"{self.path}/{name}", {n: shards[n] for n in own})
            parts[name] = own
        new = {"version": base["version"] + 1, "parent": base["version"], "schema": schema, "parts": list(parts)}
        commits.commit(self.spark, f"{self.path}/manifest", new["version"], new)
        return new | {"parts": parts, "shards": shards}

    def _write(self, df: DataFrame, rows_a_file: int = 0) -> dict:
        """Write new shards that no version names yet."""
        where = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(where)
        fs, p = file_system(self.spark, where)
        sizes = {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return {}
        counted = self.spark.read.schema(df.schema).parquet(where).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()  # a row for each shard
        rows = {r["f"]: r["n"] for r in counted}
        return {f"{where[len(self.path) + 1 :]}/{k}": {"bytes": v, "rows": rows.get(k, 0)} for k, v in sizes.items()}

    def append(self, df: DataFrame, rows_a_file: int = ARRIVAL_ROWS) -> dict:
        """Append rows as small shards; an empty table commits a version without new rows.

        Columns are matched by name. New ones widen the schema, and are null in earlier rows;
        missing ones are null in the new rows. A column of another type is a ValueError, and
        nothing is written.
        """
        base = self.manifest()
        schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields])
        if base["schema"]:
            schema = widened(T.StructType.fromJson(json.loads(base["schema"])), schema)
            df = df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        shards = {k: v for k, v in self._write(df, rows_a_file).items() if v["rows"]}
        return self.commit(base, base["shards"] | shards, schema.json())

    def read(self, version: int | None = None, names: list[str] | None = None) -> DataFrame:
        """Rows of a version, by default the latest; `names`: of these shards alone."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing was appended yet")
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        names = sorted(manifest["shards"]) if names is None else names
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def compact(self, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> dict:
        """Merge until no tier has enough shards; each round commits a version. Row counts are held against the inputs' before that."""
        while True:
            base = self.manifest()
            groups = plan_merges({k: v["bytes"] for k, v in base["shards"].items()}, target_bytes, fan_in)
            if not groups:
                return base
            shards = dict(base["shards"])
            for at in range(0, len(groups), MERGES_A_JOB):
                part = groups[at : at + MERGES_A_JOB]
                merged = self._write(reduce(DataFrame.unionAll, [self.read(base["version"], g).coalesce(1) for g in part]))
                gone = {n for g in part for n in g}
                if sum(v["rows"] for v in merged.values()) != sum(base["shards"][n]["rows"] for n in gone):
                    raise RuntimeError("a merge lost rows; nothing was committed")
                shards = {k: v for k, v in shards.items() if k not in gone} | merged
            self.commit(base, shards, base["schema"])

    def vacuum(self, keep: int = 1, retention_seconds: float = RETENTION_SECONDS) -> int:
        """Delete the versions but the last `keep`, and what none of these names, if it is older than the retention; returns how many files went.

        Versions go before their shards, so that a version that is there can be read. Shards
        and parts that another writer has written but not committed yet are young, and stay.
        """
        before = (time.time() - retention_seconds) * 1000
        kept = [self.manifest(v) for v in self.versions()[-keep:]]
        live = {n for m in kept for n in m["shards"]} | {n for m in kept for n in m["parts"]}
        fs, _ = file_system(self.spark, self.path)
        gone = 0

        def files(folder: str) -> list:
            _, p = file_system(self.spark, f"{self.path}/{folder}")
            return list(fs.listStatus(p)) if fs.exists(p) else []

        old = {s.getPath().getName() for s in files("manifest") if s.getModificationTime() <= before}
        for v in self.versions()[:-keep]:
            name = commits.path_of("", v)[1:]
            if name in old:
                gone += fs.delete(file_system(self.spark, f"{self.path}/manifest/{name}")[1], False)
        # What the versions that are left name is live too: some may be younger than the retention.
        for v in self.versions()[:-keep]:
            m = self.manifest(v)
            live |= set(m["shards"]) | set(m["parts"])
        for name in old:
            if name.startswith("part-") and f"manifest/{name}" not in live:
                gone += fs.delete(file_system(self.spark, f"{self.path}/manifest/{name}")[1], False)
        for folder in files("data"):
            inside = list(fs.listStatus(folder.getPath()))
            shards = [s for s in inside if s.getPath().getName().endswith(".parquet")]
            dead = [s for s in shards if f"data/{folder.getPath().getName()}/{s.getPath().getName()}" not in live and s.getModificationTime() <= before]
            for s in dead:
                gone += fs.delete(s.getPath(), False)
            if len(dead) == len(shards) and all(s.getModificationTime() <= before for s in inside) and (dead or folder.getModificationTime() <= before):
                fs.delete(folder.getPath(), True)
        return gone


def widened(schema: T.StructType, new: T.StructType) -> T.StructType:
    """A schema with the columns of another that it lacks; ValueError if they differ about a type."""
    own = {f.name: f.dataType for f in schema.fields}
    for f in new.fields:
        if f.name in own and own[f.name] != f.dataType:
            raise ValueError(f"{f.name} is of {own[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([*schema.fields, *(f for f in new.fields if f.name not in own)])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended, compacted and read back from the committed version: their columns, with the text's digest."""
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    store.compact()
    store.vacuum(retention_seconds=0)  # this query is the only writer
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), F.char_length("text").cast("long").alias("text_chars"))


OP10_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, CAST(length(text) AS BIGINT) AS text_chars FROM documents"
