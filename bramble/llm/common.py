"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A-Z lowered, ASCII white space as a space: for words that are runs of anything else.
_TO_SPACED = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if 0x09 <= c <= 0x0D else c for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lowered, runs of digits, letters and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; removed when the driver's Python ends.

    Where the setting is missing (local tests) a temporary folder takes its place.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="bramble-")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
        _scratch[app] = f"{base.rstrip('/')}/bramble-{app}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside, but for what is kept, is deleted in the end: nothing that is used later may be read from it."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.pop()
        for path in paths:
            remove(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _open and not keep:
        _open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_state: dict[Any, Any] = {}


def worker_state(name: Any, build: Callable[[], Any]) -> Any:
    """What a Python worker holds from one task to the next. It holds one operator's state at a time, whatever it ran before."""
    if name not in _state:
        _state.clear()
        _state[name] = build()
    return _state[name]


def no_state() -> None:
    """A Python worker drops what an earlier operator held in it: for operators that need much memory and hold nothing."""
    _state.clear()


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


#: Bits of one bitmap as Spark's functions build them, and the number of bitmaps that are sent to all executors at most: 64 MB.
_BITMAP, _BITMAPS = 32_768, 16_384


def probable(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key columns are among those of `keys` (distinct, written), and some others: a filter that spares a join's shuffle.

    Keys are hashed into bitmaps of eight bits a key, which go to all executors; if that
    were more than 64 MB, rows come back as they are.
    """
    count = -(-8 * keys.count() // _BITMAP)
    if not 0 < count <= _BITMAPS:
        return rows if count else rows.where(F.lit(False))
    names = [free_name([*rows.columns, *keys.columns], x) for x in ("bitmap", "bitmap_of", "bit")]
    bitmap, number, bit = names
    spot = F.pmod(F.xxhash64(*on), F.lit(count * _BITMAP))
    parts = [(F.floor(spot / _BITMAP)).cast("int").alias(number), (spot % _BITMAP).cast("int").alias(bit)]
    maps = keys.select(*parts).groupBy(number).agg(F.bitmap_construct_agg(bit).alias(bitmap))
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select(*rows.columns, *parts).join(F.broadcast(maps), number).where(F.getbit(byte, F.col(bit).bitwiseAND(7)) == 1).select(rows.columns)


def free_name(taken: Iterable[str], name: str) -> str:
    """A column name that clashes with none of those taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into small ones, so that a Python worker holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """As `slices`, with at most `size` bytes of text in a slice of more than one row."""
    for batch in slices(batches, rows):
        at = held = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if i > at and held + n > size:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit integers (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


#: Bytes that words are hashed in at a time, and the length from which a word is hashed by itself.
_PIECE, _LONG_WORD = 1 << 21, 1 << 16
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64)), mix64(np.arange(1001, 1257, dtype=np.uint64))


def hash_ranges(letters: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: int = 1) -> list[np.ndarray]:
    """One or two independent 64-bit hashes of each of some ranges of bytes."""
    power, inverse = powers(1 << max(16, len(letters).bit_length()))
    out = []
    for values in _LETTERS[:hashes]:
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(values[letters] * power[: len(letters)], out=sums[1:])
        out.append(mix64((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64)))
    for i in np.flatnonzero(stop - start >= _LONG_WORD).tolist():
        whole = xxhash.xxh3_128_intdigest(letters[start[i] : stop[i]].tobytes())
        for n in range(hashes):
            out[n][i] = whole >> 64 * n & (1 << 64) - 1
    return out


def _hash_piece(data: bytes) -> np.ndarray:
    letters = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], letters != 0x20, [False]])
    start, stop = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    return hash_ranges(letters, start, stop)[0]


def word_hashes(text: str | bytes | None, alnum: bool = False) -> np.ndarray:
    """64-bit hashes of a text's words: runs of what isn't ASCII white space with A-Z lowered, or those of `alnum_words`."""
    data = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").translate(_TO_WORDS if alnum else _TO_SPACED)
    if len(data) <= _PIECE:
        return _hash_piece(data)
    out, at = [], 0
    while at < len(data):
        stop = len(data) if len(data) - at <= _PIECE else data.rfind(b" ", at, at + _PIECE)
        if stop > at:
            out.append(_hash_piece(data[at:stop]))
        elif stop < 0:  # one word fills the piece
            stop = data.find(b" ", at)
            stop = len(data) if stop < 0 else stop
            out.append(np.array([xxhash.xxh3_128_intdigest(data[at:stop]) & (1 << 64) - 1], np.uint64))
        at = stop + 1
    return np.concatenate(out)
