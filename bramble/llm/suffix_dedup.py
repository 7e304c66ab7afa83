"""Exact substring dedup with per-shard suffix arrays.

A byte goes if it lies in a string of `length` bytes that starts anywhere else too. The
same search over words, as 64-bit hashes, finds passages that repeat word for word.

1. Sharding. Each window of `length` bytes has an anchor, the least hashed k-gram in it, so
   that equal windows have equal anchors at the same distance. Consecutive windows with
   one anchor are a run. Runs whose anchor occurs once can't repeat. Runs with equal whole
   content (by a 128-bit digest) repeat as a whole: copies are combined before anything is shuffled.
2. What is left, the runs around the edges of copies and one run for each repeated content,
   goes to the shard of its anchor. A shard's suffix array is built by Larsson-Sadakane
   refinement in numpy, common prefixes by Kasai's method in the order of the text.
   Windows whose suffixes share `length` bytes with a neighbour in the array repeat.
3. Merging. A hot anchor's runs are dealt over many shards. Digests of these shards' windows
   are dealt by range, sorted, and found in each other's shards by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64, powers, probable, table, temporary, text_slices, word_hashes

LENGTH, GRAM = 400, 64
#: Words of a passage, and of the grams that anchor it.
PASSAGE, PASSAGE_GRAM = 50, 6
#: Bytes of contexts that are sorted together, whole anchors at a time: what fits a core's cache is sorted in half the time.
SHARD_BYTES = 1 << 19
#: Runs of one anchor that one shard takes.
RUNS_A_SHARD = 4000
_SLICE = 4 << 20
_POSITION = np.uint64((1 << 24) - 1)


def symbols(text: bytes | None, words: bool) -> np.ndarray:
    """What a text is a string of: its bytes, or its words (A-Z lowered, apart by white space)."""
    return word_hashes(text) if words else np.frombuffer(text or b"", np.uint8)


def _bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """Texts as their UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def _windows_of_eight(data: np.ndarray, kind: str) -> np.ndarray:
    """Eight bytes from each place on as one number; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), kind, padded, strides=(1,)).astype(np.uint64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchored_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors' hashes, first and last starts of runs of windows that share an anchor; each start lies in one run."""
    for lo in range(0, len(data) - length + 1, _SLICE):
        part = data[lo : lo + _SLICE + length - 1]
        power, inverse = powers(1 << max(16, int(len(part)).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        n = len(part) - gram + 1
        hashes = mix64((sums[gram:] - sums[:-gram]) * inverse[:n])
        least = _sliding_min((hashes & ~_POSITION) | np.arange(n, dtype=np.uint64), length - gram + 1) & _POSITION
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], len(least)) - 1
        yield hashes[least[first]].view(np.int64), first + lo, last + lo


def _first_ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in order of their first symbols, the places where a new rank starts, and how many symbols that are: eight bytes, or one word."""
    n = len(data)
    if data.dtype != np.uint8:
        order = np.argsort(data)
        return order, np.concatenate([[True], data[order][1:] != data[order][:-1]]), 1
    key = _windows_of_eight(data, ">u8")
    # The last suffixes, of fewer than eight bytes, come before longer ones of the same key.
    short = max(n - 7, 0)
    order = np.argsort(key[:short])
    last = np.arange(n - 1, short - 1, -1)
    last = last[np.argsort(key[last], kind="stable")]
    order = np.insert(order, np.searchsorted(key[order], key[last]), last)
    ordered, whole = key[order], order < short
    return order, np.concatenate([[True], (ordered[1:] != ordered[:-1]) | ~whole[1:] | ~whole[:-1]]), 8


def refine(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of bytes or words, sorted by the first `depth` of them or more: Larsson-Sadakane refinement.

    Each round sorts only the groups that are still tied, by the ranks of the suffixes `h`
    further on, and doubles `h`.
    """
    n = len(data)
    order, starts, h = _first_ranks(data)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    while h < depth:
        alone = starts & np.append(starts[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        at = order[tied]
        ahead = at + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        by = np.argsort(group * (n + 1) + second)
        at, second, group = at[by], second[by], group[by]
        order[tied] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        starts[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix in `order` with the one before it, cut at its text's end: Kasai's method.

    In the order of the text, a suffix whose left neighbour has the same pair one place back,
    with an equal symbol, has one less in common; only the others are compared, eight bytes
    or one word at a time.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before = np.concatenate([[-1], order[:-1]])
    by_text = np.full(len(data), -1)
    by_text[order] = np.arange(n)
    by_text = by_text[by_text >= 0]
    i, j = order[by_text], before[by_text]
    left = np.maximum(j, 0)
    room = np.where(j < 0, 0, np.minimum(ends[i] - i, ends[left] - j))
    last = np.zeros(len(data), bool)  # of a text
    last[np.unique(ends) - 1] = True
    joined = (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1) & (j[:-1] >= 0)
    at = np.flatnonzero(joined)
    joined[at] = (data[i[at]] == data[j[at]]) & ~last[i[at]] & ~last[j[at]]
    follows = np.concatenate([[False], joined])
    if data.dtype == np.uint8:
        step, words = 8, _windows_of_eight(data, "<u8")
    else:
        step, words = 1, data
    prefix = np.zeros(n, np.int64)
    open_ = np.flatnonzero(~follows & (j >= 0) & (room > 0))
    off = 0
    while len(open_) and off < most:
        a, b = words[np.minimum(i[open_] + off, len(data) - 1)], words[np.minimum(j[open_] + off, len(data) - 1)]
        same = (a == b) & (off + step <= room[open_])
        done = open_[~same]
        diff = (a ^ b)[~same]
        low = diff & (~diff + np.uint64(1))
        first = np.where(diff == 0, step, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64) if step > 1 else 0)
        prefix[done] = np.minimum(off + first, room[done])
        prefix[open_[same]] = off + step
        open_ = open_[same]
        off += step
    chain = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    prefix = np.where(follows, np.minimum(np.maximum(prefix[chain] - (np.arange(n) - chain), 0), room), prefix)
    out = np.empty(n, np.int64)
    out[by_text] = prefix
    return out


def repeated_windows(contexts: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard by suffix array: (context, start in it, number of its group), sorted by group."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    data = np.concatenate(contexts)
    order = refine(data, length)
    order = order[ends[order] - order >= length]
    prefix = common_prefixes(data, order, ends, int(sizes.max(initial=0)))
    group = np.cumsum(prefix < length) - 1
    context = np.searchsorted(np.cumsum(sizes), order, "right")
    return context, order - (np.cumsum(sizes) - sizes)[context], group


def _intervals(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of consecutive window starts as byte ranges."""
    if not len(starts):
        return []
    starts = np.sort(starts)
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


_RUN = "doc_id {0}, twin long, h long, whole binary, first long, last long"
_FOUND = "doc_id {0}, twin long, start long, stop long, key binary, shard long"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(doc_id, twin, start, stop): ranges of bytes (or words) of texts that windows found elsewhere cover; twin is a hash of the text.

    `docs` has doc_id and text. Ranges of one text may overlap. Rows with the same id and
    text share their ranges, and are copies of each other.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("doc_id is not null and text is not null").withColumn("twin", F.xxhash64("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            of, found, wholes = [np.zeros(0, np.int64)], [], []
            for k, text in enumerate(_bytes(batch, "text")):
                data = symbols(text, words)
                view, width = memoryview(data.tobytes()), data.itemsize
                for h, first, last in anchored_runs(data, length, gram):
                    of.append(np.full(len(h), k))
                    found.append((h, first, last))
                    wholes += [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip((first * width).tolist(), ((last + length) * width).tolist(), strict=True)]
            at = pa.array(np.concatenate(of))
            h, first, last = (pa.array(np.concatenate([f[i] for f in found]) if found else [], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("twin").take(at), h, pa.array(wholes, pa.binary()), first, last], names=["doc_id", "twin", "h", "whole", "first", "last"])

    runs = materialize(texts.select("doc_id", "twin", "text").mapInArrow(find, _RUN.format(kind)), "runs")
    # Most anchors occur once: their runs go before anything wider than the anchor is shuffled.
    several = materialize(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    runs = probable(runs, several, ["h"])
    place = F.struct("doc_id", "twin", "first", "last")
    contents = materialize(runs.groupBy("h", "whole").agg(F.count("*").alias("n"), F.min(place).alias("one")), "contents")
    anchors = contents.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    shared = materialize(contents.join(anchors, "h").select("h", "whole", "n", "one", "kinds"), "shared")

    whole = runs.join(shared.where("n > 1").select("h", "whole"), ["h", "whole"], "left_semi").select("doc_id", "twin", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))

    # One run of each content of anchors with several contents; those of repeated content only stand for it.
    wanted = shared.where("kinds > 1").select("one.*", "h", F.col("n").alias("copies"), F.ceil(F.col("kinds") / RUNS_A_SHARD).alias("shards"))
    listed = materialize(wanted.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("h", "first", "last", "copies", "shards")).alias("wanted")), "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 64):
            cols: list[list] = [[], [], [], [], [], []]
            for k, (text, wants) in enumerate(zip(_bytes(batch, "text"), batch.column("wanted").to_pylist(), strict=True)):
                data = symbols(text, words)
                for w in wants:
                    for col, v in zip(cols, (k, w["h"], w["first"], data[w["first"] : w["last"] + length].tobytes(), w["copies"], w["shards"]), strict=True):
                        col.append(v)
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("twin").take(at), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())], names=["doc_id", "twin", "h", "first", "content", "copies", "shards"])

    contexts = probable(texts, listed, ["doc_id", "twin"]).join(listed, ["doc_id", "twin"]).select("doc_id", "twin", "text", "wanted").mapInArrow(fetch, f"doc_id {kind}, twin long, h long, first long, content binary, copies long, shards long")
    shard = F.xxhash64("h", F.pmod(F.xxhash64("content"), "shards"))
    sharded = contexts.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard")

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in text_slices(batches, "content", 1024):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and size > SHARD_BYTES and row[7] != rows[-1][7]:
                    yield _shard_result(rows, length, kinds, words)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield _shard_result(rows, length, kinds, words)

    kinds = _arrow_kind(docs)
    found = materialize(sharded.select("doc_id", "twin", "h", "first", "content", "copies", "shards", "shard").mapInArrow(sort_shards, _FOUND.format(kind)), "found")
    spans = found.where("key is null").select("doc_id", "twin", "start", "stop")
    merged = _merge(found.where("key is not null"), length, _FOUND.format(kind))
    return whole.union(spans).union(merged)


def _arrow_kind(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def _shard_result(rows: list[tuple], length: int, kind: pa.DataType, words: bool) -> pa.RecordBatch:
    """Spans of a shard's repeated windows; for runs of anchors that have several shards, digests of its windows."""
    contents = [np.frombuffer(r[4], np.uint64 if words else np.uint8) for r in rows]
    context, start, group = repeated_windows(contents, length)
    size = np.bincount(group) if len(group) else group
    repeats = size[group] > 1 if len(group) else np.zeros(0, bool)
    leads = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else repeats
    out: list[tuple] = []
    by = np.argsort(context, kind="stable")
    bounds = np.searchsorted(context[by], np.arange(len(rows) + 1))
    for k, (doc, twin, _, first, _, copies, shards, shard) in enumerate(rows):
        own = by[bounds[k] : bounds[k + 1]]
        if copies == 1:
            out += [(doc, twin, a + first, b + first, None, shard) for a, b in _intervals(start[own[repeats[own]]], length)]
        if shards > 1:  # windows that repeat here are settled: one of each goes on, to be found by other shards
            sent = own[~repeats[own] | leads[own]]
            out += [(doc if copies == 1 and not r else None, twin, s + first, s + first + length, xxhash.xxh3_128_digest(contents[k][s : s + length].data), shard) for s, r in zip(start[sent].tolist(), repeats[sent].tolist(), strict=True)]
    cols = list(zip(*out, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.int64())], names=["doc_id", "twin", "start", "stop", "key", "shard"])


def _merge(windows: DataFrame, length: int, schema: str) -> DataFrame:
    """Windows of split anchors that other shards have too: dealt by ranges of digests, each shard's sorted run searched in the others'."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        keys = np.array(t.column("key").to_pylist(), "S16")
        shard = t.column("shard").to_numpy()
        first, last = np.searchsorted(keys, keys, "left"), np.searchsorted(keys, keys, "right") - 1
        low, high = np.minimum.reduceat(shard, np.unique(first)), np.maximum.reduceat(shard, np.unique(first))
        number = np.cumsum(first == np.arange(len(first))) - 1
        keep = (last > first) & (low[number] != high[number]) & t.column("doc_id").is_valid().to_numpy()
        yield from t.filter(pa.array(keep)).to_batches()

    sorted_ = windows.repartitionByRange("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(search, schema).select("doc_id", "twin", "start", "stop")


def _lists(rows: DataFrame, name: str, *search) -> DataFrame:
    """All ranges of a text in one row, written; what the search wrote besides is deleted."""
    with temporary(rows.sparkSession):
        return materialize(repeated_spans(rows, *search).groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "stop")).alias(name)), name, keep=True)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM, sha256: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, or with sha256 their digest in hex as kept_sha256), and n_repeated_words, its words in passages of
    `passage` words or more that are found elsewhere too, word for word, of however few bytes.

    Texts are their UTF-8 bytes; a null text is empty. Matches lie within texts and are
    judged on the input. Texts under `length` bytes keep everything. Rows without an id keep
    everything; repeated rows are copies of each other.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = _lists(rows, "spans", length, gram).join(_lists(rows, "passages", passage, passage_gram, True), ["doc_id", "twin"], "full")
    held = rows.withColumn("twin", F.xxhash64("text")).join(spans, ["doc_id", "twin"], "left").select("doc_id", "text", "spans", "passages")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 64):
            n, gone, runs, kept, words = [], [], [], [], []
            for text, spans, passages in zip(_bytes(batch, "text"), batch.column("spans").to_pylist(), batch.column("passages").to_pylist(), strict=True):
                data = text or b""
                ranges = _merged(spans)
                n.append(len(data))
                gone.append(sum(b - a for a, b in ranges))
                runs.append(len(ranges))
                left = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in ranges)], [*(a for a, _ in ranges), len(data)], strict=True)) if ranges else data
                kept.append(hashlib.sha256(left).hexdigest() if sha256 else left)
                words.append(sum(b - a for a, b in _merged(passages)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string() if sha256 else pa.binary()), pa.array(words, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if sha256 else "kept", "n_repeated_words"])

    return held.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if sha256 else 'kept binary'}, n_repeated_words long")


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without strings of 400 bytes that start elsewhere too; nulls, empty and repeated rows as remove_repeats says, an empty table has no rows."""
    return remove_repeats(table(spark, sf_dir, "documents"), sha256=True)
