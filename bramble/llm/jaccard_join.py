"""Jaccard self-join of shingle sets with PartEnum signatures.

Sets are put in size bands, such that similar sets lie in the same band or in
neighbouring ones. Within a pair of bands, similarity bounds the number k of shingles by
which two sets differ. The shingle domain is cut into n1 parts of SECOND sub-parts: of the
n1 parts, some have at most SPARE differing shingles, and there all but SPARE sub-parts
are equal. A signature is a set's content in SECOND - SPARE sub-parts of a part; every
such subset is enumerated, so that similar sets share a signature: no link is lost.

Nodes are distinct sets; documents with equal sets are one node. Nodes that share a
signature are candidates. Signatures are shuffled with keys of KEY_BITS bits that stand
for nodes; nodes of one key all take its signatures, and are candidates too. A sketch of
each set (parities of its shingles in 512 slots) bounds from below by how many shingles
two sets differ; candidates that differ by too many are dropped before any text moves,
the others are verified on whole sets. To find components, a node is held against the
first of its bucket; then, in some rounds, against a random other one of those still
apart from it, which makes large components whole at a cost that is linear in the
bucket; what is still apart in the end is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest, free_name, materialize, mix64, no_state, probable, table, temporary, text_slices, word_hashes
from .components import connected_components

WORDS, PERCENT = 5, 80
SECOND, SPARE = 3, 1
#: Bits of signatures and of keys. What signatures lack is zero bytes, which shuffle files compress to nothing.
SIG_BITS, KEY_BITS = 48, 64
#: Slots of the sketches, 64 to a long.
SLOTS = 512
_SKETCH = [f"k{i}" for i in range(SLOTS // 64)]
#: Rounds of random centres; what is apart after them is compared in full.
ROUNDS = 2


def shingles(texts: list[str | None], words: int, alnum: bool = False) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct word shingles of each text; fewer words than a shingle has are one shingle."""
    out = []
    for text in texts:
        ids = word_hashes(text, alnum)
        n = len(ids)
        k = min(words, n)
        acc = np.full(n - k + 1 if n else 0, k, np.uint64)
        for j in range(k):
            acc = mix64(acc ^ ids[j : n - k + 1 + j]) + np.uint64(0x9E3779B97F4A7C15)
        acc.sort()
        out.append(acc[np.concatenate([[True], acc[1:] != acc[:-1]])] if n else acc)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@lru_cache(maxsize=8)
def bands(percent: int, largest: int = 1 << 40) -> tuple[int, ...]:
    """Smallest sizes of the bands: the next band begins above the largest size that can be similar to its smallest."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return tuple(out)


@lru_cache(maxsize=4096)
def instance(band: int, percent: int) -> tuple[int, int, np.ndarray]:
    """Of the pairs of sets in `band` and the one above: first-level parts, those that must agree, and salts."""
    low = bands(percent)
    a = low[band + 1] - 1
    b = min(low[band + 2] - 1, a * 100 // percent)
    k = (100 - percent) * (a + b) // (100 + percent)
    bad = k // (SPARE + 1)
    n1 = bad + 1
    if k:
        n1 += 1 + n1 // 16
    salts = mix64(np.arange(n1 * SECOND, dtype=np.uint64) + np.uint64((band + 1) << 40)).reshape(n1, SECOND)
    return n1, n1 - bad, salts


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets, of their own bands and the ones below, and the number of the set each belongs to."""
    low = np.array(bands(percent))
    own = np.searchsorted(low, [len(s) for s in sets], "right") - 1
    found, of = [], []
    for below in (0, 1):
        # Sets of different single sizes can't be similar.
        chosen = [i for i, b in enumerate(own.tolist()) if b >= below and not (below and low[b] - low[b - 1] == 1 and instance(b - 1, percent)[0] == 1)]
        if not chosen:
            continue
        parts = [instance(int(own[i]) - below, percent) for i in chosen]
        items = np.concatenate([sets[i] for i in chosen])
        sizes, n1 = np.array([len(sets[i]) for i in chosen]), np.array([p[0] for p in parts])
        base = np.cumsum(n1 * SECOND) - n1 * SECOND
        cell = (mix64(items ^ np.uint64(0xA0761D6478BD642F)) % np.repeat((n1 * SECOND).astype(np.uint64), sizes)).astype(np.int64) + np.repeat(base, sizes)
        total = int((n1 * SECOND).sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, cell, mix64(items))
        sums, counts = sums.reshape(-1, SECOND), np.bincount(cell, minlength=total).reshape(-1, SECOND)
        rest = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums  # all sub-parts but one
        full = counts.sum(axis=1)[:, None] - counts > 0
        # Signatures of empty content are needed only where too few parts are sure to have content.
        empty = np.add.reduceat((~full.all(axis=1)).astype(np.int64), np.cumsum(n1) - n1)
        keep = full | np.repeat(empty >= np.array([p[1] for p in parts]), n1)[:, None]
        found.append(mix64(rest + np.concatenate([p[2] for p in parts]))[keep])
        of.append(np.repeat(np.repeat(np.array(chosen), n1), SECOND).reshape(-1, SECOND)[keep])
    return (np.concatenate(found), np.concatenate(of)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of longs for each set: the parities of its shingles in SLOTS slots, which the top bits of their hashes choose."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slot = (np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)
    odd = np.bincount(owner * SLOTS + slot, minlength=len(sets) * SLOTS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view("<i8").reshape(len(sets), -1)


def _sets(texts: DataFrame, words: int, alnum: bool) -> DataFrame:
    """doc_id, twin, n_shingles, node (a 128-bit digest of the set; null for an empty one) and the sketch."""
    schema = T.StructType([texts.schema["doc_id"], T.StructField("twin", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in _SKETCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_state()
        for batch in text_slices(batches, "text"):
            sets = shingles(batch.column("text").to_pylist(), words, alnum)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), *map(pa.array, sketches(sets).T)], names=schema.names)

    return texts.mapInArrow(run, schema)


def _signature_rows(texts: DataFrame, words: int, percent: int, alnum: bool) -> DataFrame:
    """A row (sig, key) for each signature of each distinct set of a task; keys as `_key` gives them."""
    sig_mask, spare_bits = np.uint64((1 << 64) - (1 << 64 - SIG_BITS)), np.int64(64 - KEY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_state()
        seen: set[bytes] = set()
        for batch in text_slices(batches, "text"):
            new: dict[bytes, np.ndarray] = {}
            for items in shingles(batch.column("text").to_pylist(), words, alnum):
                if len(items) and (key := digest(items.tobytes())) not in seen:
                    seen.add(key)
                    new[key] = items
            found, of = signatures(list(new.values()), percent)
            keys = np.array([xxhash.xxh64_intdigest(node, 42) for node in new], np.uint64).view(np.int64) >> spare_bits
            yield pa.RecordBatch.from_arrays([pa.array((found & sig_mask).view(np.int64)), pa.array(keys[of])], names=["sig", "key"])

    return texts.mapInArrow(run, "sig long, key long")


def _key() -> Column:
    return F.shiftright(F.xxhash64("node"), 64 - KEY_BITS)


def _may_be_similar(percent: int, a: str = "a_", b: str = "b_") -> Column:
    """Whether sizes and sketches of two sets leave it open that they are similar. Never false for similar sets."""
    n, m = F.col(a + "n_shingles"), F.col(b + "n_shingles")
    apart = F.lit(0)
    for c in _SKETCH:
        apart = apart + F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c)))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


class _Linker:
    """Verified links and components of the nodes of one join."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, words: int, percent: int, alnum: bool):
        self.texts, self.nodes, self.words, self.percent, self.alnum = texts, nodes, words, percent, alnum
        self.tried: DataFrame | None = None
        self.found: DataFrame | None = None

    def side(self, name: str) -> DataFrame:
        return self.nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n_shingles", *_SKETCH)])

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that sizes and sketches leave open."""
        return pairs.join(self.side("a"), "a").join(self.side("b"), "b").where(_may_be_similar(self.percent)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are similar. Pairs are sorted by a, whose set is made once for a run of them."""
        text_a, text_b = (probable(self.texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")), pairs.select(x).distinct(), [x]) for x in "ab")
        both = pairs.join(text_b, "b").join(text_a, "a").select("a", "b", "text_a", "text_b")
        words, percent, alnum = self.words, self.percent, self.alnum

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = held = None
            for batch in text_slices(batches, "text_b"):
                keep = []
                for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b").to_pylist(), strict=True):
                    if a != last:
                        last, (held,) = a, shingles([ta.as_py()], words, alnum)
                    keep.append(similar(held, shingles([tb], words, alnum)[0], percent))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return both.mapInArrow(run, pairs.select("a", "b").schema)

    def link(self, pairs: DataFrame) -> bool:
        """Verify pairs that weren't yet, and join the components of those that are similar; whether there were any."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        links = materialize(self.verified(pairs), "links")
        if links.isEmpty():
            return False
        known = links if self.found is None else links.union(self.found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.found = connected_components(known)
        return True

    def components(self, rows: DataFrame) -> DataFrame:
        """Rows with a node, and its component c."""
        if self.found is None:
            return rows.withColumn("c", F.col("node"))
        return rows.join(self.found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", alnum: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, twin, n_shingles, node), one for each of `docs`, and the nodes' components with their first rows (node, first: no id, doc_id, twin)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("twin"), F.col(text_col).alias("text"))
    sets = materialize(_sets(texts, words, alnum), "sets")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "twin")
    one = F.struct(place.alias("first"), "n_shingles", *_SKETCH)
    nodes = materialize(sets.where("n_shingles > 0").groupBy("node").agg(F.min(one).alias("s")).select("node", "s.*"), "nodes")

    # One text of each node gives its signatures (and, where a bitmap can't tell, some more do).
    reps = nodes.select("node", "first.doc_id", "first.twin")
    rows = _signature_rows(probable(texts, reps, ["doc_id", "twin"]).select("text"), words, percent, alnum)
    bucket = Window.partitionBy("sig")
    rows = rows.withColumn("first", F.min("key").over(bucket)).withColumn("last", F.max("key").over(bucket)).where("first <> last")
    keys = nodes.select("node", _key().alias("key"))
    twins = keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    shared = materialize(rows.join(keys, "key").select("sig", "node", "key", "first").union(twins.select(F.col("key").alias("sig"), "node", "key", F.col("key").alias("first"))), "buckets")
    members = materialize(reps.join(shared.select("node").distinct(), "node"), "members").select("node", F.col("doc_id").alias("id"), F.col("twin").alias("of"))
    few = probable(texts, members.select(F.col("id").alias("doc_id"), F.col("of").alias("twin")), ["doc_id", "twin"])
    held = few.join(members, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("twin") == F.col("of"))).select("node", "text").dropDuplicates(["node"])
    linker = _Linker(materialize(held, "texts"), nodes, words, percent, alnum)

    pairs = shared.where("key <> first").select("node", "first").distinct()
    linker.link(linker.bounded(pairs.join(keys.select(F.col("node").alias("other"), F.col("key").alias("first")), "first").select(*_ordered("node", "other")).distinct()))
    apart = shared.select("sig", "node")

    def still_apart(rows: DataFrame) -> DataFrame:
        known = linker.components(rows.select("sig", "node"))
        return materialize(known.withColumn("low", F.min("c").over(bucket)).withColumn("high", F.max("c").over(bucket)).where("low <> high").select("sig", "node", "c"), "apart")

    apart = still_apart(apart)
    for n in range(ROUNDS):
        chance = F.xxhash64("node", F.lit(n))
        centre = F.min_by(F.struct("node", "c"), chance).over(bucket)
        pairs = apart.withColumn("centre", centre).where("c <> centre.c").select("node", F.col("centre.node").alias("other")).select(*_ordered("node", "other")).distinct()
        if not linker.link(linker.bounded(pairs)):
            break
        apart = still_apart(apart)
    rest = materialize(apart.join(nodes.select("node", "n_shingles", *_SKETCH), "node"), "apart")
    left, right = (rest.select("sig", F.col("node").alias(x), F.col("c").alias("c" + x), *[F.col(c).alias(f"{x}_{c}") for c in ("n_shingles", *_SKETCH)]) for x in "ab")
    linker.link(left.join(right, "sig").where((F.col("ca") < F.col("cb")) & _may_be_similar(percent)).select(*_ordered("a", "b")).distinct())

    known = linker.components(nodes.select("node", "first"))
    labels = known.groupBy("c").agg(F.min("first").alias("first"))
    return sets.select("doc_id", "twin", "n_shingles", "node"), known.select("node", "c").join(labels, "c").select("node", "first")


def link_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", alnum: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id that links lead to.

    Two rows link where 100 * intersection >= percent * union of their shingle sets. Null and
    empty texts, or those without words, have no shingles and link with nothing. Rows of one
    id are documents of their own, which link by their texts alone. Rows without an id link
    like others, and have no component_id if no row with an id is in reach. An empty table
    gives an empty table; texts may have any length.
    """
    rows, labels = link_rows(docs, words, percent, id_col, text_col, alnum)
    return rows.join(labels, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id (and, of that, of the text of the least hash); all columns.

    Rows without an id come last. Rows that are equal in id and text are one; texts without
    words are in no component, and stay.
    """
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("twin") == F.col("first.twin")))
    id_, of, nth = (free_name(docs.columns, x) for x in ("gone_id", "gone_twin", "nth"))
    with temporary(docs.sparkSession):
        rows, labels = link_rows(docs, words, percent, id_col, text_col, alnum=True)
        gone = materialize(rows.join(labels, "node").where(later).select(F.col("doc_id").alias(id_), F.col("twin").alias(of)).distinct(), "gone", keep=True)
    held = docs.join(gone, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(of)), "left_anti")
    twins = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(1))
    return held.withColumn(nth, F.row_number().over(twins)).where(F.col(nth) == 1).select(docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of whole documents by shingles of four words at 85 percent; nulls, repeated and empty rows as link_documents says."""
    return link_documents(table(spark, sf_dir, "documents"), words=4, percent=85)
