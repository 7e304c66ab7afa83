"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has probabilities of the vocabulary's pieces. A word's likelihood sums the
products of piece probabilities over all its segmentations (the forward algorithm); a
text's is the product over its words. Piece probabilities are learned by expectation
maximisation over all segmentations of training words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, materialize, slices, table, worker_state

#: Documents of each language that op7 learns from, about (by a hash of their ids): the bound of its fit. The pipeline's fit has none.
FIT_DOCS = 400
ROUNDS, SMOOTH = 3, 0.01
UNKNOWN = 1e-7
#: Words of more letters are summed with rescaling: their probabilities are too small for a float.
LONG_WORD = 32
#: A text is foreign to its language if its log likelihood per letter is FLOOR_MARGIN below that of all but this share of
#: the language's training documents. Texts of n letters get SHORT_TEXT / sqrt(n) on top: their means scatter.
FLOOR_SHARE, FLOOR_MARGIN, SHORT_TEXT = 0.01, 0.5, 3.0
UNDETERMINED = "und"
#: Parts of a unit of likelihood per letter that floors are looked for in.
_BINS = 256
_CACHE = 300_000
_RUNS = re.compile(r"[^\W\d_]+")
_START = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[str, ...]:
    """The vocabulary's pieces, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return tuple(sorted({sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}))


def letter_runs(text: str | None) -> list[str]:
    """Lower-case runs of letters (and of signs that Python counts among word characters)."""
    return _RUNS.findall(text.lower()) if text else []


def word_unit(run: str) -> str:
    """The letters of a run as the forward algorithm takes them, behind a start sign; nothing if there are none."""
    if not run.isalpha():
        run = "".join(filter(str.isalpha, run))
    return _START + run if run else ""


@lru_cache(maxsize=64)
def _spans(size: int, longest: int) -> list[tuple[int, int]]:
    """Places that a piece can take in a word, by their ends."""
    return [(i, j) for j in range(1, size + 1) for i in range(max(0, j - longest), j)]


def _piece_ids(units: list[str], ids: dict[str, int], longest: int) -> np.ndarray:
    """Numbers of the pieces at all `_spans` of units of one length. Behind the pieces: what is no piece, and an unknown letter."""
    spans, get = _spans(len(units[0]), longest), ids.get
    places = [(i, j, len(ids) + (j == i + 1)) for i, j in spans]
    return np.array([get(u[i:j], d) for u in units for i, j, d in places], np.int32).reshape(len(units), len(spans))


def expected_uses(units: list[str], langs: np.ndarray, counts: np.ndarray, table: np.ndarray, ids: dict[str, int], longest: int) -> np.ndarray:
    """Expected uses of pieces, shaped as `table` (languages, pieces and what `_piece_ids` has behind them): `expected_counts` of units of one length at once."""
    size, width = len(units[0]), table.shape[1]
    if size > LONG_WORD:
        out = np.zeros(table.shape)
        for unit, lang, n in zip(units, langs.tolist(), counts.tolist(), strict=True):
            probs = {s: table[lang, ids[s]] for i, j in _spans(size, longest) if (s := unit[i:j]) in ids}
            for piece, share in expected_counts(unit, probs, longest).items():
                if piece in ids:
                    out[lang, ids[piece]] += n * share
        return out
    spans = _spans(size, longest)
    cells = (_piece_ids(units, ids, longest) + langs[:, None] * width).T
    p = table.ravel()[cells]
    alpha, beta = np.zeros((2, size + 1, len(units)))
    alpha[0] = beta[size] = 1.0
    for k, (i, j) in enumerate(spans):
        alpha[j] += alpha[i] * p[k]
    for k, (i, j) in reversed(list(enumerate(spans))):
        beta[i] += beta[j] * p[k]
    for k, (i, j) in enumerate(spans):
        p[k] *= alpha[i] * beta[j]
    p /= alpha[size]
    p[p <= 1e-6] = 0.0
    return np.bincount(cells.ravel(), (p * counts).ravel(), table.size).reshape(table.shape)


def expected_counts(word: str, probs: dict[str, float], longest: int) -> dict[str, float]:
    """Expected uses of each piece in a word, over all segmentations by their probability (forward and backward).

    Sums are rescaled as they get small: each place has the logarithm of what its sums were divided by.
    """
    size = len(word)
    arcs = [(i, j, p) for j in range(1, size + 1) for i in range(max(0, j - longest), j) if (p := probs.get(word[i:j], UNKNOWN if j == i + 1 else 0.0))]
    alpha, beta = [1.0] + [0.0] * size, [0.0] * size + [1.0]
    if size <= LONG_WORD:
        for i, j, p in arcs:
            alpha[j] += alpha[i] * p
        for i, j, p in reversed(arcs):
            beta[i] += beta[j] * p
        shares = ((i, j, alpha[i] * p * beta[j] / alpha[size]) for i, j, p in arcs) if alpha[size] > 0 else ()
    else:
        a, b = _scaled_sums(size, arcs), _scaled_sums(size, [(size - j, size - i, p) for i, j, p in arcs])[::-1]
        shares = ((i, j, math.exp(min(0.0, a[i] + math.log(p) + b[j] - a[size]))) for i, j, p in arcs)
    out: dict[str, float] = {}
    for i, j, share in shares:
        if share > 1e-6:
            out[word[i:j]] = out.get(word[i:j], 0.0) + share
    return out


def _scaled_sums(size: int, arcs: list[tuple[int, int, float]]) -> list[float]:
    """Logarithms of the sums over all paths from 0 to each place."""
    into: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
    for i, j, p in arcs:
        into[j].append((i, p))
    out = [0.0] * (size + 1)
    for j in range(1, size + 1):
        top = max(out[i] for i, _ in into[j])
        out[j] = top + math.log(sum(p * math.exp(out[i] - top) for i, p in into[j]))
    return out


class LanguageModel:
    """Piece probabilities of each language; small enough to be sent to every worker (vocabulary size times languages)."""

    def __init__(self, languages: list[str], probs: dict[str, tuple[float, ...]], prior: list[float]):
        self.languages, self.prior = languages, prior
        #: The least `likelihood_per_letter` of a text in each language; a language without training texts has none.
        self.floors: dict[str, float] = {}
        self.ids = {p: i for i, p in enumerate(probs)}
        n = len(languages)
        #: Behind the pieces: what is no piece, and an unknown letter.
        self.table = np.array([*probs.values(), (0.0,) * n, (UNKNOWN,) * n]).reshape(len(probs) + 2, n)
        self.longest = max(map(len, probs), default=1)

    def likelihoods(self, units: list[str]) -> np.ndarray:
        """Probabilities of units of one length in each language, over all segmentations: the forward algorithm, for all units at once."""
        spans, ids = _spans(len(units[0]), self.longest), _piece_ids(units, self.ids, self.longest)
        alpha = np.zeros((len(units[0]) + 1, len(units), len(self.languages)))
        alpha[0] = 1.0
        for k, (i, j) in enumerate(spans):
            alpha[j] += alpha[i] * self.table[ids[:, k]]
        return alpha[-1]

    def log_likelihoods(self, units: list[str]) -> np.ndarray:
        """Logarithms of `likelihoods`, for words of any length: sums are rescaled place by place, and those of the last places alone are held."""
        size = len(units[0])
        if size <= LONG_WORD:
            return np.log(np.maximum(self.likelihoods(units), 1e-300))
        get, none, unknown = self.ids.get, len(self.ids), len(self.ids) + 1
        shape = (len(units), len(self.languages))
        held, total = [np.ones(shape)], np.zeros(shape)
        for j in range(1, size + 1):
            now = np.zeros(shape)
            for back, alpha in enumerate(reversed(held), 1):
                now += alpha * self.table[[get(u[j - back : j], unknown if back == 1 else none) for u in units]]
            total += np.log(now)
            held = [alpha / now for alpha in held[1 - self.longest :]] if self.longest > 1 else []
            held.append(np.ones(shape))
        return total

    def words(self, runs: list[str]) -> np.ndarray:
        """A row for each run of letters: its log likelihood in each language, then its letters (and start sign), or zeros if it has no letter."""
        out = np.zeros((len(runs), len(self.languages) + 1))
        by_size: dict[int, list[tuple[int, str]]] = {}
        for k, run in enumerate(runs):
            if unit := word_unit(run):
                by_size.setdefault(len(unit), []).append((k, unit))
        for size, units in by_size.items():
            for at in range(0, len(units), 20_000):
                part = units[at : at + 20_000]
                rows = [k for k, _ in part]
                out[rows, :-1] = self.log_likelihoods([u for _, u in part])
                out[rows, -1] = size
        return out


def likelihood_per_letter(total: float, letters: float) -> float:
    """An absolute measure of how well a text fits a language, whatever other languages are known."""
    return total / letters + SHORT_TEXT / math.sqrt(letters)


class Scorer:
    """Scores texts with a bounded cache of words, of two generations: a word in use when the younger fills up is kept."""

    def __init__(self, model: LanguageModel):
        self.model, self.width = model, len(model.languages) + 1
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((_CACHE, self.width))
        self.older, self.older_scores = {}, self.scores
        self.prior = np.log(np.maximum(model.prior, 1e-12)) if model.languages else np.zeros(0)

    def _learn(self, parts: list[list[str]]) -> None:
        """Scores of all words of these parts, which are fewer than the cache holds."""
        new = {w for p in parts for w in p if w not in self.rows}
        if len(self.rows) + len(new) > _CACHE:
            self.older, self.older_scores = self.rows, self.scores
            self.rows, self.scores = {}, np.zeros((_CACHE, self.width))
            new = {w for p in parts for w in p}
        at = len(self.rows)
        kept = [w for w in new if w in self.older]
        fresh = [w for w in new if w not in self.older]
        self.scores[at : at + len(kept)] = self.older_scores[[self.older[w] for w in kept]]
        self.scores[at + len(kept) : at + len(new)] = self.model.words(fresh)
        self.rows.update(zip(kept + fresh, range(at, at + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [self._best(row) for row in self.totals(texts)]

    def known(self, texts: list[str | None], min_score: float) -> list[bool]:
        """Whether texts are in a language of the model: by posterior, and by the likelihood itself."""
        out = []
        for row in self.totals(texts):
            lang, score = self._best(row)
            out.append(lang != UNDETERMINED and score >= min_score and self.fit(row, lang) >= self.model.floors.get(lang, -math.inf))
        return out

    def fit(self, row: np.ndarray, lang: str) -> float:
        return likelihood_per_letter(float(row[self.model.languages.index(lang)]), float(row[-1]))

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: log likelihood in each language, then letters."""
        total = np.zeros((len(texts), self.width))
        pending: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            self._learn([p for _, p in pending])
            for k, part in pending:
                total[k] += self.scores[list(map(self.rows.__getitem__, part))].sum(axis=0)
            pending.clear()

        for k, text in enumerate(texts if self.model.languages else []):
            words = letter_runs(text)
            for at in range(0, len(words), _CACHE // 8):
                pending.append((k, words[at : at + _CACHE // 8]))
                size += len(pending[-1][1])
                if size > _CACHE // 4:
                    flush()
                    size = 0
        flush()
        return total

    def _best(self, row: np.ndarray) -> tuple[str, float]:
        if not row[-1]:
            return UNDETERMINED, 0.0
        like = row[:-1] + self.prior
        best = int(like.argmax())
        return self.model.languages[best], float(1.0 / np.exp(like - like[best]).sum())


def _scorer(name: str, sent) -> Scorer:
    """A Python worker's scorer, with its cache, lives on between tasks of one query."""
    return worker_state(name, lambda: Scorer(sent.value))


def _quantiles(rows: DataFrame, share: float) -> dict[str, float]:
    """The quantile of `value` in each `lang`, exact and as numpy interpolates, from counts of bins and the few values where it lies."""
    rows = rows.select("lang", "value", F.floor(F.col("value") * _BINS).alias("bin"))
    bins: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("lang", "bin").agg(F.count("*").alias("n")).collect():
        bins.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    wanted = []  # the bin of a rank, and its place in there
    for lang, found in bins.items():
        last = sum(n for _, n in found) - 1
        for rank in {int(last * share), min(last, int(last * share) + 1)}:
            at = 0
            for number, n in sorted(found):
                if at <= rank < at + n:
                    wanted.append((lang, number, rank, rank - at))
                at += n
    if not wanted:
        return {}
    places = rows.sparkSession.createDataFrame(wanted, "lang string, bin long, rank long, place long")
    values = rows.join(F.broadcast(places.select("lang", "bin").distinct()), ["lang", "bin"]).groupBy("lang", "bin", "value").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang", "bin").orderBy("value")
    values = values.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(places), ["lang", "bin"]).where("place < upto and place >= upto - n")
    held: dict[str, dict[int, float]] = {}
    for r in values.select("lang", "rank", "value").collect():
        held.setdefault(r["lang"], {})[r["rank"]] = r["value"]
    out = {}
    for lang, found in bins.items():
        low, *high = (held[lang][k] for k in sorted(held[lang]))
        spot = (sum(n for _, n in found) - 1) * share
        out[lang] = low + (spot - int(spot)) * (high[0] - low) if high else low
    return out


def fit(docs: DataFrame, vocabulary: str | None = None, fit_docs: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", floors: bool = True) -> LanguageModel:
    """Learn a model from the rows of `docs` with a language: from all of them, unless `fit_docs` bounds them.

    With a bound, about `fit_docs` documents of each language are read, chosen by a hash of
    their ids (all where a language has fewer). What comes to the driver is bounded by the
    vocabulary's size times the number of languages. Without floors the model tells
    languages apart, but not texts that are in none of them.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {}, [])
    if fit_docs is not None:
        shares = docs.sparkSession.createDataFrame([(lang, math.ceil(1_000_000 * min(1.0, fit_docs / n))) for lang, n in sizes.items()], "lang string, share long")
        rows = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share"))  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "unit": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([found[k] for k in keys], pa.int64())})

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for run, n in Counter(letter_runs(text)).items():
                    if unit := word_unit(run):
                        found[lang, unit] += n
                if len(found) > 200_000:
                    yield out()
                    found.clear()
        if found:
            yield out()

    words = materialize(rows.select("lang", "text").mapInArrow(count, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")), "langid")
    pieces = load_pieces(vocabulary)
    ids, number = {p: i for i, p in enumerate(pieces)}, {lang: i for i, lang in enumerate(languages)}
    probs = np.full((len(languages), len(pieces)), 1.0 / len(pieces))
    longest = max(map(len, pieces))
    context = docs.sparkSession.sparkContext
    for _ in range(ROUNDS):
        sent = context.broadcast((ids, number, np.column_stack([probs, np.zeros(len(probs)), np.full(len(probs), UNKNOWN)])))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, number, table = sent.value
            total = np.zeros(table.shape)
            by_size: dict[int, list[tuple[str, int, int]]] = {}

            def add(size: int) -> None:
                units, langs, counts = zip(*by_size.pop(size), strict=True)
                np.add(total, expected_uses(units, np.array(langs), np.array(counts), table, ids, longest), out=total)

            for batch in batches:
                for lang, unit, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "unit", "n")), strict=True):
                    held = by_size.setdefault(len(unit), [])
                    held.append((unit, number[lang], n))
                    if len(held) == 5000:
                        add(len(unit))
            for size in list(by_size):
                add(size)
            lang, piece = np.nonzero(total[:, : len(ids)])
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "piece": pa.array(piece, pa.int32()), "n": pa.array(total[lang, piece])})

        uses = words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        probs = np.full(probs.shape, SMOOTH)
        probs[uses.column("lang").to_numpy(), uses.column("piece").to_numpy()] += uses.column("n").to_numpy()
        probs /= probs.sum(axis=1, keepdims=True)
        sent.unpersist()
    everything = sum(sizes.values())
    model = LanguageModel(languages, dict(zip(pieces, map(tuple, probs.T.tolist()), strict=True)), [sizes[lang] / everything for lang in languages])
    if not floors:
        return model
    sent, name = context.broadcast(model), uuid.uuid4().hex

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, sent)
        for batch in slices(batches):
            langs, totals = batch.column("lang").to_pylist(), scorer.totals(batch.column("text").to_pylist())
            found = [(lang, scorer.fit(row, lang)) for lang, row in zip(langs, totals, strict=True) if row[-1]]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in found], pa.string()), "value": pa.array([x[1] for x in found], pa.float64())})

    fits = materialize(rows.select("lang", "text").mapInArrow(measure, "lang string, value double"), "langid")
    sent.unpersist()
    model.floors = {lang: v - FLOOR_MARGIN for lang, v in _quantiles(fits, FLOOR_SHARE).items()}
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred and score, the posterior of the predicted language.

    A null text, or one without letters, is `und` with score 0; so is every text if the
    model knows no language. Ties go to the first language in order. Repeated rows give a row each.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, sent)
        for batch in slices(batches):
            found = scorer.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).alias("text" if id_col != "text" else "text_")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of which the language is one that the model knows; all columns.

    That takes a posterior of min_score or more and, as a posterior only compares the known
    languages, a likelihood per letter that is not below the language's floor.
    """
    at = docs.columns.index(text_col)
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, sent)
        for batch in slices(batches):
            yield batch.filter(pa.array(scorer.known(batch.column(at).to_pylist(), min_score), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole documents by what the rows that aren't held out say; null texts and those without a letter are `und`, repeated rows one row each, an empty table has none."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 3) != 1), fit_docs=FIT_DOCS, floors=False)
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
