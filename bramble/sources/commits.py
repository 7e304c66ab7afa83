"""Versions of a folder, committed atomically: a version is a file that comes into being by a rename that fails if it exists."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer has committed the version that this one was about to commit."""


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions committed under a folder, in order."""
    fs, p = file_system(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(int(n[1:-5]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("v") and n.endswith(".json"))


def path_of(folder: str, version: int) -> str:
    return f"{folder}/v{version:012d}.json"


def read_json(spark: SparkSession, path: str) -> Any:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, content: Any) -> None:
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    stream = fs.create(p, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()


def commit(spark: SparkSession, folder: str, version: int, content: Any) -> None:
    """Make `content` this version; ConflictError if another writer was first. A crash before the rename leaves no version."""
    jvm, name = spark._jvm, path_of(folder, version)
    fs, tmp = file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    write_json(spark, tmp.toString(), content)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(tmp).toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(name)), options)
    except Exception as e:
        fs.delete(tmp, False)
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            raise ConflictError(f"version {version} exists") from e
        raise
