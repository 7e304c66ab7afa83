"""Token ids in a content-addressed store: rolling-hash chunks, each stored once, and document recipes.

Format, Parquet files under one path:

* `content`: a row of kind chunk for each distinct chunk: its digest (`key`), number of ids
  and payload, little-endian unsigned ids; and rows of kind recipe, not yet in order.
* `recipes`: documents in ascending doc_id order over files and rows: digests and lengths
  of their chunks, the Merkle root over the digests, ids before the document in its part
  (`local_start`) and the part's number.
* `manifest`: for each part of the recipes its documents, ids and the Merkle root over its
  documents' roots, and a row for all chunks (their number, ids and a sum of their digests).
* `format`: the type of the ids.

Texts are encoded and cut in one pass, of which chunks and recipes go through one shuffle;
a task sends a chunk once, whatever number of copies it read, so that a chunk that all
documents share has a row for each task at most. Reading back verifies digests, roots,
lengths and the manifest: a lost chunk, recipe or part doesn't go unseen.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest, mix64, new_path, slices, table, text_slices
from .tokens import default_vocabulary, encoder

END_ID = 1
MIN_IDS, MEAN_BITS, MAX_IDS = 64, 8, 1024
_REACH = 8


def cut_points(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> list[list[int]]:
    """Chunk ends for each document of a batch of concatenated ids; bounds: its documents' ends.

    A cut follows an id where the rolling hash of the last eight ids has MEAN_BITS zero
    bits; chunks have MIN_IDS to MAX_IDS ids, the last one of a document any number.
    """
    own = table[ids]
    rolled = own.copy()
    for j in range(1, _REACH):
        rolled[j:] += own[:-j] << np.uint64(j) if len(own) > j else 0
    marks = np.flatnonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0) + 1
    out, lo = [], 0
    for hi in bounds.tolist():
        ends, last = [], lo
        for m in marks[np.searchsorted(marks, lo, "right") : np.searchsorted(marks, hi)].tolist():
            while m - last > MAX_IDS:
                last += MAX_IDS
                ends.append(last)
            if m - last >= MIN_IDS:
                last = m
                ends.append(m)
        while hi - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if last < hi:
            ends.append(hi)
        out.append(ends)
        lo = hi
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree over digests; leaves and inner nodes are hashed under different prefixes."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _wide(payload: bytes, dtype: str) -> bytes:
    return payload if dtype == "<u4" else np.frombuffer(payload, dtype).astype("<u4").tobytes()


def chunk_documents(docs: DataFrame, vocabulary: str, end_id: int, dtype: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks and recipes in one pass: a row for each chunk that is new to its task (kind, key, n, payload), and for each document (kind, key, doc_id, row, digests, lengths)."""
    schema = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("payload", T.BinaryType()),
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("lengths", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = encoder(vocabulary, dtype), np.dtype(dtype).itemsize
        gear = mix64(np.arange(1, enc.size + 1, dtype=np.uint64))
        row, sent = TaskContext.get().partitionId() << 36, set()
        for batch in text_slices(batches, "text", size=1 << 20):
            ids, ends = enc.encode_all(batch.column("text").to_pylist(), end_id)
            joined, cuts = ids.tobytes(), cut_points(ids, ends, gear)
            keys, sizes, new, last = [], [], {}, 0
            for e in itertools.chain.from_iterable(cuts):
                payload = joined[last * width : e * width]
                key = digest(payload)
                if key not in sent:
                    sent.add(key)
                    new[key] = payload
                keys.append(key)
                sizes.append(e - last)
                last = e
            chunks, n = len(new), len(cuts)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cuts])]), pa.int32())
            columns = [
                (pa.array(["chunk"] * chunks, pa.string()), pa.array(["recipe"] * n, pa.string())),
                (pa.array(list(new), pa.binary()), pa.array([digest(i.to_bytes(8, "little")) for i in range(row, row + n)], pa.binary())),
                (pa.array([len(x) // width for x in new.values()], pa.int32()), None),
                (pa.array(list(new.values()), pa.binary()), None),
                (None, batch.column("doc_id")),
                (None, pa.array(range(row, row + n), pa.int64())),
                (None, pa.ListArray.from_arrays(offsets, pa.array(keys, pa.binary()))),
                (None, pa.ListArray.from_arrays(offsets, pa.array(sizes, pa.int32()))),
            ]
            row += n
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(chunks, b.type) if a is None else a, pa.nulls(n, a.type) if b is None else b]) for a, b in columns], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows, which hold all rows of their keys, the first of each key."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for key in batch.column("key").to_pylist():
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _content(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField("kind", T.StringType()), *schema.fields])).parquet(f"{path}/content").where(F.col("kind") == kind).drop("kind")


_CHUNK = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("payload", T.BinaryType())])


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode documents and write them as a store under `path`, in any folder that Spark can write.

    A null or empty text gives the end id alone. Repeated rows are documents of their own
    that share chunks; they keep the order of their input rows. Rows without an id come
    first. An empty table gives empty folders.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    dtype = "<u2" if encoder(vocabulary, "<u2").size <= 1 << 16 and end_id < 1 << 16 else "<u4"
    rows = chunk_documents(docs, vocabulary, end_id, dtype, id_col, text_col)
    rows.repartition("key").mapInArrow(_once, rows.schema).write.option("compression", "zstd").parquet(f"{path}/content")

    fields = T.StructType([rows.schema[c] for c in ("doc_id", "row", "digests", "lengths")])
    ordered = _content(spark, path, "recipe", fields).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    schema = T.StructType([*fields.fields, T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("local_start", T.LongType()), T.StructField("part", T.IntegerType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = [sum(x) for x in batch.column("lengths").to_pylist()]
            roots = [merkle_root(x) for x in batch.column("digests").to_pylist()]
            starts = (start + np.cumsum([0, *n])).tolist()
            start = starts[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(roots, pa.binary()), pa.array(starts[:-1], pa.int64()), pa.array([part] * len(n), pa.int32())], names=schema.names)

    ordered.mapInArrow(number, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")
    spark.createDataFrame([(dtype,)], "dtype string").coalesce(1).write.parquet(f"{path}/format")
    _manifest(spark, path).coalesce(1).write.parquet(f"{path}/manifest")


_PART = "part int, n_rows long, n_ids long, root binary"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """What the manifest should say, from the files: a row for each part of the recipes, and one (part -1) for all chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_ids"), F.array_sort(F.collect_list(F.struct("local_start", "row", "root"))).alias("roots")).select("part", "n_rows", "n_ids", F.col("roots.root").alias("root"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root(x) for x in batch.column("root").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, pa.binary())], names=["part", "n_rows", "n_ids", "root"])

    total = F.sum(F.xxhash64("key").cast("decimal(38,0)"))
    chunks = _content(spark, path, "chunk", _CHUNK).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_ids"), F.coalesce(total, F.lit(0)).cast("string").cast("binary").alias("root"))
    return parts.mapInArrow(fold, _PART).union(chunks.select(F.lit(-1).alias("part"), "n_rows", "n_ids", "root"))


def faults(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the manifest that the files don't bear out, and parts it doesn't name: part (-1: the chunks), n_rows, found_rows. Empty for a whole store."""
    told = spark.read.parquet(f"{path}/manifest")
    found = _manifest(spark, path).select("part", F.col("n_rows").alias("found_rows"), F.col("n_ids").alias("found_ids"), F.col("root").alias("found_root"))
    return told.join(found, "part", "full").where("not (n_rows <=> found_rows and n_ids <=> found_ids and root <=> found_root)").select("part", "n_rows", "found_rows")


def _gf_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bits reversed as zlib has them."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), b >> np.uint64(1) ^ np.uint64(0xEDB88320), b >> np.uint64(1))
    return out


def crc_shift(n_bytes: np.ndarray) -> np.ndarray:
    """x to the power of 8 * n_bytes modulo CRC-32's polynomial."""
    out = np.full(len(n_bytes), 1 << 31, np.uint64)
    power = np.full(1, 1 << 23, np.uint64)  # x^8
    left = n_bytes.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), _gf_times(out, np.broadcast_to(power, out.shape)), out)
        power = _gf_times(power, power)
        left >>= np.uint64(1)
    return out


def crc_combine(crcs: np.ndarray, n_bytes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of `counts` consecutive byte strings, from their CRC-32s and lengths."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(n_bytes)])
    after = np.repeat(total[ends], counts) - total[1:]
    terms = _gf_times(crc_shift(after), crcs.astype(np.uint64))
    return np.bitwise_xor.reduceat(terms, ends - counts) if len(terms) else terms


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their ids rebuilt from the store: doc_id, row, ids (array of long), verified.

    A document of which a chunk is lost or not what its digest says, or the root differs, has null ids and isn't verified.
    """
    dtype = spark.read.parquet(f"{path}/format").first()[0]
    chunks = _content(spark, path, "chunk", _CHUNK).select(F.col("key").alias("digest"), "payload")
    refs = spark.read.parquet(f"{path}/recipes").select("doc_id", "row", "root", F.posexplode("digests").alias("idx", "digest"))
    docs = refs.join(chunks, "digest", "left").groupBy("doc_id", "row", "root").agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "payload"))).alias("c"))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["row"], T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("verified", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = []
            for root, c in zip(batch.column("root").to_pylist(), batch.column("c").to_pylist(), strict=True):
                good = merkle_root([x["digest"] for x in c]) == root and all(x["payload"] is not None and digest(x["payload"]) == x["digest"] for x in c)
                ids.append(np.frombuffer(b"".join(x["payload"] for x in c), dtype).astype(np.int64) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.list_(pa.int64())), pa.array([x is not None for x in ids], pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back. Per document: doc_id, start, n_tokens, ids_crc32, verified.

    Payloads are read from the files, held against their digests and summed chunk by chunk;
    recipes put the sums together, so that payloads needn't be shuffled again. A document is
    verified if its chunks are, its root is theirs, and its part is as the manifest has it.
    """
    dtype = spark.read.parquet(f"{path}/format").first()[0]
    width = np.dtype(dtype).itemsize

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            data = batch.column("payload").to_pylist()
            keys = batch.column("digest")
            right = [digest(p) == k for p, k in zip(data, keys.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(p) // width for p in data], pa.int32()), pa.array([zlib.crc32(_wide(p, dtype)) for p in data], pa.int64()), pa.array(right)], names=["digest", "n", "crc", "right"])

    chunks = _content(spark, path, "chunk", _CHUNK).select(F.col("key").alias("digest"), "payload").mapInArrow(sums, "digest binary, n int, crc long, right boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("doc_id", "row", "root", "part", "local_start", F.posexplode("digests").alias("idx", "digest"))
    docs = refs.join(chunks, "digest", "left").groupBy("doc_id", "row", "root", "part", "local_start").agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "n", "crc", "right"))).alias("c"))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("local_start", "n_tokens", "ids_crc32")), T.StructField("part", T.IntegerType()), T.StructField("good", T.BooleanType())])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            lists = batch.column("c")
            counts = np.diff(lists.offsets.to_numpy())
            chunk = lists.flatten()
            n, crc, right = (np.nan_to_num(chunk.field(x).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) for x in ("n", "crc", "right"))
            keys, ends = chunk.field("digest").to_pylist(), np.cumsum(counts)
            good = [merkle_root(keys[e - k : e]) == root for e, k, root in zip(ends.tolist(), counts.tolist(), batch.column("root").to_pylist(), strict=True)]
            right = np.minimum.reduceat(right, ends - counts) > 0 if len(n) else right
            total = np.add.reduceat(n, ends - counts) if len(n) else n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("local_start"), pa.array(total, pa.int64()), pa.array(crc_combine(crc, 4 * n, counts).astype(np.int64), pa.int64()), batch.column("part"), pa.array(np.array(good, bool) & right, pa.bool_())], names=schema.names)

    # A row for each part; their number is that of the shuffle's partitions at most.
    bad = faults(spark, path).select("part", F.lit(True).alias("bad"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = spark.read.parquet(f"{path}/manifest").where("part >= 0").select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    parts = told.join(bad, "part", "left")
    return docs.mapInArrow(combine, schema).join(F.broadcast(parts), "part", "left").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", (F.col("good") & F.col("base").isNotNull() & F.col("bad").isNull()).alias("verified"))


def op8_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents encoded, stored and read back. A null or empty text is the end id alone; repeated rows are documents of their own; an empty table has no rows."""
    path = new_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path)
    return verify_store(spark, path)
