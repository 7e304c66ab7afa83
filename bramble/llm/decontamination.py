"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Training texts are streamed through the automaton word by word, which yields at each
word the longest match that ends there; windows of test items that occur in a text
follow from these lengths alone. Cost: linear in the words of the texts.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, free_name, materialize, slices, table, worker_state

WINDOW = 8
#: Bytes of test items in one automaton; larger benchmarks are dealt over several, one after another. An automaton takes
#: some 20 bytes for each word and state of its items: 4 MB of them stay under 100 MB in a Python worker.
BLOCK_BYTES = 4 << 20


class SuffixAutomaton:
    """A generalised suffix automaton over word sequences, with the items of each window.

    A window is `window` consecutive words of an item; an item of fewer words, but not
    none, is one window. States are rows of flat arrays: most have one transition and one
    item; only the others have a dictionary or a set of their own.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        #: Of each state: its only (or first) transition's word and target, suffix link, longest length, and item.
        self.word, self.to, self.link, self.length, self.item = (array("i", [-1]) for _ in range(5))
        self.length[0] = 0
        self.more: dict[int, dict[int, int]] = {}
        texts: dict[tuple[int, ...], set[int]] = {}
        self.names: list[str] = []
        for name, text in items:
            ids = tuple(self.words.setdefault(w, len(self.words)) for w in alnum_words(text))
            if ids:
                texts.setdefault(ids, set()).add(len(self.names))
                self.names.append(name)
        for ids in texts:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for ids, own in texts.items():
            self._mark(ids, own)
        self.short_up = self._short_up() if self.short else {}

    def _next(self, state: int, c: int) -> int:
        """The target of a transition, or -1."""
        if self.word[state] == c:
            return self.to[state]
        return self.more[state].get(c, -1) if state in self.more else -1

    def _set(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (c, -1):
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _state(self, word: int, to: int, link: int, length: int) -> int:
        for column, value in zip((self.word, self.to, self.link, self.length, self.item), (word, to, link, length, -1), strict=True):
            column.append(value)
        return len(self.word) - 1

    def _extend(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        q = self._next(last, c)
        if q >= 0:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(-1, -1, 0, length[last] + 1)
        p = last
        while p != -1 and (q := self._next(p, c)) < 0:
            self._set(p, c, cur)
            p = link[p]
        if p != -1:
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        link = self.link
        clone = self._state(self.word[q], self.to[q], link[q], self.length[p] + 1)
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        link[q] = clone
        while p != -1 and self._next(p, c) == q:
            self._set(p, c, clone)
            p = link[p]
        return clone

    def _up(self, state: int, n: int) -> int:
        """The state that holds the last n words of a state's strings."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _mark(self, ids: tuple[int, ...], own: set[int]) -> None:
        state, n = 0, len(ids)
        for k, c in enumerate(ids, 1):
            state = self._next(state, c)
            if k >= self.window:
                at = self._up(state, self.window)
                if self.item[at] < 0 and len(own) == 1:
                    (self.item[at],) = own
                elif {self.item[at]} != own:
                    self.items.setdefault(at, set()).update(own)
        if n < self.window:
            self.short.setdefault(self._up(state, n), {}).setdefault(n, set()).update(own)

    def _short_up(self) -> dict[int, list[tuple[int, set[int]]]]:
        """For each state, the short items that end there, by rising length; states without any have no entry."""
        out: dict[int, list[tuple[int, set[int]]]] = {}
        for state in sorted(range(1, len(self.word)), key=self.length.__getitem__):
            above, own = out.get(self.link[state]), self.short.get(state)
            if above or own:
                out[state] = (above or []) + sorted(own.items()) if own else above
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words as (start, end), and the items with windows that occur."""
        get, word, target, more, link, length = self.words.get, self.word, self.to, self.more, self.link, self.length
        window, short, item, items = self.window, self.short_up, self.item, self.items
        state = size = 0
        runs: list[list[int]] = []
        found: set[int] = set()

        def hit(lo: int, hi: int) -> None:
            while runs and runs[-1][0] >= lo:
                runs.pop()
            if runs and runs[-1][1] >= lo:
                runs[-1][1] = hi
            else:
                runs.append([lo, hi])

        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                state = size = 0
                continue
            while word[state] != c and (state not in more or c not in more[state]) and state:
                state = link[state]
                size = length[state]
            if word[state] == c:
                state = target[state]
            elif state in more and c in more[state]:
                state = more[state][c]
            else:
                size = 0
                continue
            size += 1
            if size >= window:
                at = self._up(state, window)
                if item[at] >= 0:
                    found.add(item[at])
                if at in items:
                    found |= items[at]
                hit(i + 1 - window, i + 1)
            if short and state in short:
                for n, own in short[state]:
                    if n <= size:
                        found |= own
                        hit(i + 1 - n, i + 1)
        return [(a, b) for a, b in runs], {self.names[i] for i in found}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[Broadcast]:
    """Test items in broadcasts of checked size: the item list is dealt over as many blocks as its bytes need; the driver holds one block at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = 1 + int(total) // block_bytes
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else items
        yield spark.sparkContext.broadcast(([tuple(r) for r in rows.collect()], window))


def _automaton(name: str, block: Broadcast) -> SuffixAutomaton:
    """The automaton of a block: built once in each Python worker, which holds one at a time."""
    return worker_state(name, lambda: SuffixAutomaton(*block.value))


_SCAN = "n_words long, runs array<struct<start:long,stop:long>>, items array<string>"


def scan_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, n_words, runs of hit words, items with windows that occur in it.

    Null or empty texts have no words. Repeated item ids are one item with the windows
    of all its rows; null item ids and items without words are never found. Each document
    row gives a row, however many blocks the benchmark takes.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_bytes, window))
    if len(blocks) == 1:
        return _scan(source, blocks[0]).withColumnRenamed("id", id_col)
    rows = _numbered(source, "row")
    return rows.select("row", "id").join(_scan_blocks(rows.select(F.col("row").alias("id"), "text"), blocks).withColumnRenamed("id", "row"), "row").drop("row").withColumnRenamed("id", id_col)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own, written once: it tells equal rows, and rows without an id, apart in all later passes."""
    return materialize(rows.withColumn(name, F.monotonically_increasing_id()), "scanned")


def _scan(source: DataFrame, block: Broadcast) -> DataFrame:
    """Of each row (id, text): id, n_words, runs and items, for the test items of one block."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(name, block)
        for batch in slices(batches):
            n, runs, items = [], [], []
            for text in batch.column("text").to_pylist():
                words = alnum_words(text)
                r, found = auto.scan(words)
                n.append(len(words))
                runs.append([{"start": a, "stop": b} for a, b in r])
                items.append(sorted(found))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(items, pa.list_(pa.string()))], ["id", "n_words", "runs", "items"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {_SCAN}")


def _scan_blocks(source: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """As _scan, over several blocks: runs and items of all of them. The ids must be unique."""
    hits = _scan(source, blocks[0])
    for block in blocks[1:]:
        hits = hits.unionByName(_scan(source, block).where("size(items) > 0"))
    hits = hits.groupBy("id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merge = F.aggregate(
        "runs", F.array().cast("array<struct<start:long,stop:long>>"),
        lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= r["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], r["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(r))),
    )
    return hits.withColumn("runs", merge)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove from each text the spans that windows of test items cover; drop texts of which more than max_coverage is covered.

    Columns are those of `docs`. A span runs from its first hit word to its last; where
    words remain on both sides one space takes its place. Texts without hits come back
    byte for byte, null and empty ones included. The schema may hold any further columns.
    Spans and coverage are those of all test items together in the text as it came,
    however many blocks these take.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_bytes, window))

    def scrub(batches: Iterator[pa.RecordBatch], runs_of: Callable[[pa.RecordBatch, list[list[bytes]]], list]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keep, changed = batch.column(at).to_pylist(), [], False
            words = [alnum_words(text) for text in texts]
            for k, runs in enumerate(runs_of(batch, words)):
                if not runs:
                    keep.append(True)
                    continue
                changed = True
                keep.append(sum(b - a for a, b in runs) <= max_coverage * len(words[k]))
                texts[k] = cut_words(texts[k], runs)
            arrays, fields = batch.columns[: len(schema)], pa.schema([batch.schema.field(i) for i in range(len(schema))])
            if changed:
                arrays[at] = pa.array(texts, fields.field(at).type)
            out = pa.RecordBatch.from_arrays(arrays, schema=fields)
            yield out.filter(pa.array(keep)) if changed else out

    if len(blocks) == 1:
        name, block = uuid.uuid4().hex, blocks[0]

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _automaton(name, block)
            return scrub(batches, lambda _, words: [auto.scan(w)[0] for w in words])

        return docs.mapInArrow(one, schema)

    row, runs = free_name(docs.columns, "row"), free_name(docs.columns, "runs")
    rows = _numbered(docs, row)
    found = _scan_blocks(rows.select(F.col(row).alias("id"), F.col(text_col).alias("text")), blocks).where("size(runs) > 0").select(F.col("id").alias(row), F.col("runs").alias(runs))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scrub(batches, lambda batch, _: [[(r["start"], r["stop"]) for r in x or ()] for x in batch.column(batch.num_columns - 1).to_pylist()])

    return rows.join(found, row, "left").select(*[rows[c] for c in docs.columns], runs).mapInArrow(several, schema)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the given runs of words."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(data)]
    out, last = [], 0
    for a, b in runs:
        out.append(data[last : spans[a][0]])
        last = spans[b - 1][1]
        while last < len(data) and data[last : last + 1] in b" \t":
            last += 1
    out.append(data[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all test items in whole documents; null and empty texts have no words, repeated rows a row each, an empty table none."""
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


OP1_SQL = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (
  SELECT DISTINCT item, least(len(w), 8) AS k, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
pos AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM docs, (SELECT DISTINCT k FROM wins)),
hits AS (
  SELECT p.doc_id, p.i, p.k, x.item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM pos) p JOIN wins x USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(m.n, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
