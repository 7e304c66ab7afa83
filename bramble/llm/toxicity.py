"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Words (and word beginnings) that go with the label are mined from a bounded sample of
   labelled rows and dealt over lexicon voters; pattern voters look at the form of a text.
   A labelled row is voted on by words that were mined from the other half of the rows.
2. A generative model estimates, by expectation maximisation, each voter's votes given the
   class and, in a tree of dependencies, the vote it is most correlated with. The
   annotator is a voter too, whose accuracy is estimated like that of the others; rows
   without a label, of which a bounded sample is read, have the other votes alone.
3. A logistic regression on the posterior labels of all these rows scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, materialize, slices, table

#: Labelled rows, and rows without a label, that are learned from, about (by a hash of their ids): the bounds of the fit.
FIT_ROWS, FIT_UNLABELLED = 8000, 2000
LEXICON, LEAST_DOCS = 600, 3
#: A term must go with the label in this share of its documents, at the lower end of a 90 % interval.
LEAST_PRECISION = 0.6
GROUPS = 8
PREFIX = 5
#: Common insults of English, a voter of its own.
INSULTS = frozenset("idiot idiots moron stupid loser losers scum trash pathetic worthless disgusting clown dumb fool jerk".split())
_WORDS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[^\w\s.,;:'\"()-]")


def terms(text: str | None) -> tuple[set[str], int]:
    """Distinct lower-case words of a text, beginnings that words share (with a * for one word, two and four), and its number of words."""
    words = _WORDS.findall(text.lower()) if text else []
    own = set(words)
    starts = Counter([w[:PREFIX] for w in own if len(w) > PREFIX])
    own.update([p + "*" for p in starts])
    own.update([p + "**" for p, n in starts.items() if n >= 2])
    own.update([p + "****" for p, n in starts.items() if n >= 4])
    return own, len(words)


def patterns(text: str | None, n_words: int) -> list[float]:
    """Form of a text: shares of capitals, signs, exclamation marks and one-word repeats, and its length."""
    n = len(text) if text else 0
    if not n:
        return [0.0] * 4
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n
    return [capitals, len(_SIGNS.findall(text)) / n, text.count("!") / n, min(1.0, n_words / 5000)]


class Features:
    """Turns texts into votes and into features of the linear classifier."""

    def __init__(self, lexicon: list[tuple[str, float]]):
        self.lexicon = {w: i for i, (w, _) in enumerate(lexicon)}
        self.weight = np.array([z for _, z in lexicon])
        self.group = np.array([zlib.crc32(w.encode()) % GROUPS for w, _ in lexicon], np.int64)

    def hits(self, text: str | None) -> tuple[list[int], set[str], list[float], int]:
        own, n = terms(text)
        return sorted(self.lexicon[w] for w in self.lexicon.keys() & own), own, patterns(text, n), n

    def votes(self, hits: list[int], own: set[str], form: list[float]) -> list[int]:
        """1: toxic, 0: not, -1: abstains."""
        groups = {int(self.group[i]) for i in hits}
        strength = float(self.weight[hits].sum()) if hits else 0.0
        return [
            *(1 if g in groups else -1 for g in range(GROUPS)),
            1 if own & INSULTS else -1,
            1 if len(hits) >= 3 else 0 if not hits else -1,
            1 if len(hits) >= 6 else -1,
            1 if strength >= 1.2 else 0 if strength < 0.4 else -1,
            0 if len(groups) <= 1 else -1,
            1 if form[0] > 0.5 else -1,
            1 if form[1] > 0.2 else -1,
            1 if form[2] > 0.05 else -1,
        ]

    def vector(self, hits: list[int], own: set[str], form: list[float], n_words: int) -> np.ndarray:
        x = np.zeros(len(self.lexicon) + 9)
        x[hits] = 1.0
        k = len(self.lexicon)
        strength = self.weight[hits].sum() if hits else 0.0
        x[k : k + 9] = [1.0, min(1.0, len(hits) / 5), min(3.0, strength), float(bool(own & INSULTS)), min(2.0, 20 * len(hits) / (n_words + 20)), *form]
        return x


class LabelModel:
    """A generative model of votes: the class, then each voter given the class and the voter it depends on (a tree).

    The first column is the annotator, a voter like the others, but that none depends on it:
    annotators look at texts, not at voters.
    """

    #: Votes that count as right before any is seen: a voter is better than chance. Sight of a pair counts against twice the voter alone.
    TRUST, SHARE, SMOOTH, ALONE = 4.0, 0.7, 0.5, 2.0
    #: Rounds in which the tree is made, from the classes as they are then; least information, in nats, for a dependency.
    TREES, LEAST_INFORMATION = (3, 12), 0.01

    def __init__(self, votes: np.ndarray, rounds: int = 60):
        """votes: rows by voters of -1 (abstains), 0, 1."""
        one = np.eye(3)[votes + 1]  # rows, voters, what was voted
        ones, zeros = (votes[:, 1:] == 1).sum(axis=1), (votes[:, 1:] == 0).sum(axis=1)
        base = ((votes[:, 0] == 1).sum() + 1) / ((votes[:, 0] >= 0).sum() + 2)
        # To begin with the annotator is believed; without one, a row's votes move it from the base rate.
        post = np.where(votes[:, 0] == 1, 0.95, np.where(votes[:, 0] == 0, 0.05, base * (0.5 + 0.5 * (ones + 0.5) / (ones + zeros + 1))))
        self.parent = [-1] * votes.shape[1]
        for step in range(rounds):
            weight = np.stack([1 - post, post])
            self.prior = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
            if step in self.TREES:
                self.parent = self._tree(one, weight)
            self.tables = [self._table(one, weight, j) for j in range(votes.shape[1])]
            new = self._posterior(votes)
            if step > self.TREES[-1] and np.abs(new - post).max() < 1e-4:
                break
            post = new
        self.labels = post
        right = post[:, None] * (votes == 1) + (1 - post)[:, None] * (votes == 0)
        #: Share of a voter's votes that are right.
        self.accuracy = right.sum(axis=0) / np.maximum((votes >= 0).sum(axis=0), 1)

    def _table(self, one: np.ndarray, weight: np.ndarray, j: int) -> np.ndarray:
        """Probabilities of votes by class and vote of the voter that j depends on (one row if it depends on none)."""
        alone = weight @ one[:, j] + self.SMOOTH + self.TRUST * np.array([[0, self.SHARE, 1 - self.SHARE], [0, 1 - self.SHARE, self.SHARE]])
        alone = (alone / alone.sum(axis=1, keepdims=True))[:, None, :]
        if self.parent[j] < 0:
            return alone
        both = np.einsum("cn,np,nv->cpv", weight, one[:, self.parent[j]], one[:, j], optimize=True) + self.ALONE * alone
        return both / both.sum(axis=2, keepdims=True)

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        score = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, (table_, parent) in enumerate(zip(self.tables, self.parent, strict=True)):
            score += (np.log(table_[1]) - np.log(table_[0]))[votes[:, parent] + 1 if parent >= 0 else 0, votes[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    def _tree(self, one: np.ndarray, weight: np.ndarray) -> list[int]:
        """For each voter the one it depends on: the tree of the largest information between votes within the classes, without what tells next to nothing."""
        m = one.shape[1]
        self.information = np.zeros((m, m))
        for w in weight:
            both = np.einsum("n,niu,njv->ijuv", w, one, one, optimize=True) + 1e-9
            both /= both.sum(axis=(2, 3), keepdims=True)
            apart = both.sum(axis=3, keepdims=True) * both.sum(axis=2, keepdims=True)
            self.information += w.sum() / weight.sum() * (both * np.log(both / apart)).sum(axis=(2, 3))
        np.fill_diagonal(self.information, 0.0)
        parent, inside, outside = [-1] * m, [1][: m - 1], list(range(2, m))
        while outside:
            i, j = max(((i, j) for i in inside for j in outside), key=lambda x: (self.information[x], -x[1]))
            parent[j] = i if self.information[i, j] >= self.LEAST_INFORMATION else -1
            inside.append(j)
            outside.remove(j)
        return parent


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


class ToxicityModel:
    """Lexicon and weights; bounded by LEXICON entries."""

    def __init__(self, features: Features, weights: np.ndarray, labels: LabelModel | None = None):
        self.features, self.weights = features, weights
        #: Of the annotator and the voters; and which voter each depends on.
        self.voter_accuracy = None if labels is None else labels.accuracy
        self.voter_parent = None if labels is None else labels.parent

    def score(self, text: str | None) -> float:
        f = self.features
        z = float(f.vector(*f.hits(text)) @ self.weights)
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def precision_bound(toxic, clean):
    """Lower end of Wilson's interval for the share of toxic documents (of numbers or Spark columns)."""
    n, z = toxic + clean, 1.645
    share = toxic / n
    return (share + z * z / (2 * n) - z * ((share * (1 - share) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_unlabelled: int = FIT_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from about `fit_rows` labelled rows and `fit_unlabelled` others, chosen by a hash of their ids.

    Null labels and labels without a document are left out; of several labels of a
    document the largest counts. Rows without an id count as having no label. Texts may be
    null, empty or of any length, rows repeated. Without rows of both classes every score
    is the base rate. Documents are read once; what is chosen of them is written.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    spot = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000))
    share, other = (int(1_000_000 * min(1.0, n / max(1, df.count()))) for n, df in ((fit_rows, own), (fit_unlabelled, docs)))
    chosen = own.where(spot <= share).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    read = materialize(texts.join(F.broadcast(chosen), "id", "left").where(F.col("y").isNotNull() | (F.pmod(F.xxhash64(F.lit("other"), F.col("id").cast("string")), F.lit(1_000_000)) < other)), "toxicity")  # chosen has about fit_rows rows
    unlabelled = read.where("y is null").join(own.select("id"), "id", "left_anti")
    rows = read.where("y is not null").unionByName(unlabelled).withColumn("half", F.when(F.col("y").isNotNull(), F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))).otherwise(2).cast("int"))
    rows = rows.select("text", "y", "half")
    labelled = rows.where("y is not null")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found: dict[str, list[int]] = {}
            for text, y, half in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), batch.column("half").to_pylist(), strict=True):
                for w in terms(text)[0]:
                    found.setdefault(w, [0, 0, 0, 0])[2 * half + (1 if y else 0)] += 1
            yield pa.RecordBatch.from_pydict({"w": pa.array(list(found), pa.string()), **{c: pa.array([n[i] for n in found.values()], pa.int64()) for i, c in enumerate(("c0", "t0", "c1", "t1"))}})

    base = labelled.agg(F.count("*"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0))).first()
    total, toxic = int(base[0]), int(base[1] or 0)
    if not toxic or toxic == total:
        features = Features([])
        rate = (toxic + 0.5) / (total + 1.0) if total else 0.5
        weights = np.zeros(9)
        weights[0] = np.log(rate / (1 - rate)) if total else -1.0
        return ToxicityModel(features, weights)
    counts = materialize(labelled.mapInArrow(words, "w string, c0 long, t0 long, c1 long, t1 long").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]).where(F.col("t0") + F.col("t1") >= LEAST_DOCS), "terms")

    def mined(bad: Column, clean: Column) -> Features:
        best = counts.where(bad >= LEAST_DOCS).withColumn("z", precision_bound(bad, clean)).where(F.col("z") >= LEAST_PRECISION).orderBy(F.desc("z"), "w").limit(LEXICON).collect()
        return Features([(r["w"], r["z"]) for r in best])

    # A half is voted on by what the other one says; rows without a label, and all new texts, by all of it.
    features = mined(F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"))
    sent = docs.sparkSession.sparkContext.broadcast([mined(F.col("t1"), F.col("c1")), mined(F.col("t0"), F.col("c0")), features])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *halves, whole = sent.value
        for batch in slices(batches):
            texts, half = batch.column("text").to_pylist(), batch.column("half").to_pylist()
            seen = [whole.hits(t) for t in texts]
            votes = [[-1 if y is None else int(y > 0), *(whole.votes(*h[:3]) if k == 2 else halves[k].votes(*halves[k].hits(t)[:3]))] for t, h, k, y in zip(texts, seen, half, batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in seen], pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32())), pa.array([whole.vector(*h)[len(whole.lexicon) :] for h in seen], pa.list_(pa.float64()))], names=["hits", "votes", "rest"])

    table_ = rows.mapInArrow(look, "hits array<int>, votes array<int>, rest array<double>").toPandas()  # about fit_rows and fit_unlabelled short rows
    table_ = table_.iloc[np.argsort([repr((list(v), list(r))) for v, r in zip(table_["votes"], table_["rest"], strict=True)], kind="stable")]
    model = LabelModel(np.array(table_["votes"].tolist(), np.int64))
    x = np.zeros((len(table_), len(features.lexicon) + 9))
    for row, (hits, rest) in enumerate(zip(table_["hits"], table_["rest"], strict=True)):
        x[row, list(hits)] = 1.0
        x[row, len(features.lexicon) :] = rest
    return ToxicityModel(features, logistic(x, model.labels), model)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and a score of 0 to 1. Null and empty texts have the score of a text without any sign."""
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(sent.value.score, batch.column(1).to_pylist()), pa.float64())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).alias("text" if id_col != "text" else "text_")).mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole documents by what the rows that aren't held out say; null and empty texts have a score too, repeated rows one each, an empty table none."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = crc_mod("doc_id", 5) != 0
    model = fit(docs.where(learned), labels.where(learned))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
