"""Order-preserving packing of documents into training sequences by dynamic programming.

Each input partition is a stream of ids in row order. Windows are cut at document ends
(free), sentence ends (small penalty) or, in long stretches without either, every
STRIDE ids (larger penalty); the cuts minimise padding plus penalties, with a
monotone queue for the sliding minimum: constant time for each candidate cut. Blocks of
windows are committed as they fill, so memory is bounded whatever a partition holds. No shuffle.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_slices
from .tokens import default_vocabulary, encoder

LIMIT, END_ID = 4096, 2
SENTENCE_PENALTY, WORD_PENALTY = 8.0, 48.0
STRIDE = 128
BLOCK = 64


def best_cuts(x: list[int], pen: list[float], limit: int) -> tuple[list[float], list[int]]:
    """Least cost up to each candidate cut, and the cut before it; x[0] is 0, gaps are at most limit.

    cost(j) = min over i with x[j] - x[i] <= limit of cost(i) + limit - (x[j] - x[i]) + pen[j]
    """
    cost, back = [0.0], [0]
    key = [0.0]
    queue = deque([0])
    for j in range(1, len(x)):
        xj = x[j]
        while xj - x[queue[0]] > limit:
            queue.popleft()
        i = queue[0]
        c = key[i] + limit - xj + pen[j]
        k = c + xj
        cost.append(c)
        back.append(i)
        key.append(k)
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    return cost, back


class Packer:
    """Packs a stream of documents; sequence ids count up from `first`."""

    def __init__(self, ends: np.ndarray, limit: int, first: int, with_ids: bool):
        self.ends, self.limit, self.sequence, self.with_ids = ends, limit, first, with_ids
        self.keys: list = []
        self.sizes: list[int] = []
        self.before: list[int] = []
        self.left = 0
        self.buffer: list[bytes] = []
        self.total = 0

    def add(self, key, data: bytes) -> list[tuple]:
        self.keys.append(key)
        self.sizes.append(len(data) // 4)
        self.buffer.append(data)
        self.total += len(data) // 4
        return self.flush(False) if self.total - self.left >= BLOCK * self.limit else []

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are settled; all of them if it is the last call."""
        if not self.keys:
            return []
        data = b"".join(self.buffer)
        ids = np.frombuffer(data, "<u4")[self.left :]
        n = len(ids)
        doc_ends = np.cumsum(self.sizes) - self.left
        cuts, pen = self._candidates(ids, doc_ends)
        cost, back = best_cuts(cuts, pen, self.limit)
        tail = [j for j in range(len(cuts) - 1, -1, -1) if n - cuts[j] < self.limit] if last else [j for j in range(len(cuts) - 1, 0, -1) if n - cuts[j] < self.limit]
        if last:  # what is left is cut to powers of two, which need no padding
            end = min(tail, key=lambda j: cost[j] + SENTENCE_PENALTY * (n - cuts[j]).bit_count())
        else:
            end = min(tail, key=cost.__getitem__)
        windows, j = [], end
        while j:
            windows.append((cuts[back[j]], cuts[j]))
            j = back[j]
        windows.reverse()
        at = cuts[end]
        if last:
            for bit in range(self.limit.bit_length() - 1, -1, -1):
                if n - at >> bit & 1:
                    windows.append((at, at + (1 << bit)))
                    at += 1 << bit
        out = self._pieces(windows, doc_ends, data)
        done = int(np.searchsorted(doc_ends, at, "right"))
        gone = int(doc_ends[done - 1]) + self.left if done else 0
        self.keys, self.sizes, self.buffer = self.keys[done:], self.sizes[done:], [data[4 * gone :]] if done < len(self.sizes) else []
        self.total = sum(self.sizes)
        self.left = at + self.left - gone if self.keys else 0
        if self.buffer:  # one part for each document that is left
            parts, lo = [], 0
            for s in self.sizes:
                parts.append(self.buffer[0][4 * lo : 4 * (lo + s)])
                lo += s
            self.buffer = parts
        return out

    def _candidates(self, ids: np.ndarray, doc_ends: np.ndarray) -> tuple[list[int], list[float]]:
        n = len(ids)
        pen = np.full(n + 1, np.inf)
        pen[np.flatnonzero(self.ends[ids]) + 1] = SENTENCE_PENALTY
        pen[doc_ends] = 0.0
        pen[0] = 0.0
        cuts = np.flatnonzero(pen < np.inf)
        stride = min(STRIDE, self.limit)
        for k in np.flatnonzero(np.diff(cuts) > stride).tolist():
            pen[cuts[k] + stride : cuts[k + 1] : stride] = WORD_PENALTY
        cuts = np.flatnonzero(pen < np.inf)
        return cuts.tolist(), pen[cuts].tolist()

    def _pieces(self, windows: list[tuple[int, int]], doc_ends: np.ndarray, data: bytes) -> list[tuple]:
        out, d = [], 0
        ends, view = doc_ends.tolist(), memoryview(data)
        for lo, hi in windows:
            at = lo
            while at < hi:
                while ends[d] <= at:
                    d += 1
                to = min(hi, ends[d])
                part = view[4 * (at + self.left) : 4 * (to + self.left)]
                start = at - (ends[d] - self.sizes[d])
                out.append((self.keys[d], start, to - at, zlib.crc32(part), self.sizes[d], self.sequence, at - lo, bytes(part) if self.with_ids else None))
                at = to
            self.sequence += 1
        return out


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, limit: int = LIMIT, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    `ids` holds little-endian unsigned 32-bit ids (left out unless with_ids). A null or
    empty text is the end id alone. Rows keep the order they have in their input partition;
    repeated rows are packed like others. Sequences fill at most `limit` (a power of two)
    ids; only a partition's last ones may be shorter without padding, at powers of two.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    vocabulary = vocabulary or default_vocabulary()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in names), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        packer = Packer(enc.ends(), limit, TaskContext.get().partitionId() << 32, with_ids)
        kind = None

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7]), *([pa.array(cols[7], pa.binary())] if with_ids else [])], names=schema.names)

        for batch in text_slices(batches, "text", size=1 << 20):
            kind = batch.column("doc_id").type
            pieces, start = [], 0
            ids, ends = enc.encode_all(batch.column("text").to_pylist(), end_id)
            for key, stop in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                pieces += packer.add(key, ids[start:stop].tobytes())
                start = stop
            if pieces:
                yield rows(pieces)
        if pieces := packer.flush(True):
            yield rows(pieces)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole documents; null and empty texts are the end id alone, texts of any length are cut, repeated rows are packed each, an empty table has no pieces."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
