"""Language ID, toxicity, fingerprints, sharding and the pipeline on small fixtures."""

import itertools
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bramble.llm import fingerprints as P
from bramble.llm import language_id as L
from bramble.llm import toxicity as X
from bramble.llm.sharding import ConflictError, ShardStore, plan_merges

SF = "/root/testdata/sf0.001"
have_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_forward_sums_all_segmentations():
    probs = {"a": (0.3, 0.1), "b": (0.2, 0.5), "ab": (0.1, 0.2), "ba": (0.05, 0.1), "aba": (0.01, 0.02)}

    def brute(word, k):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            p = 1.0
            for i, j in itertools.pairwise(at):
                piece = word[i:j]
                p *= probs[piece][k] if piece in probs else L.UNKNOWN if j == i + 1 else 0.0
            total += p
        return total

    for word in ("a", "ab", "abab", "babaab", "xab"):
        got = L.LanguageModel(["p", "q"], probs, [0.5, 0.5]).likelihoods([word, word])
        for k in (0, 1):
            assert got[0, k] == got[1, k] == pytest.approx(brute(word, k))
    model = L.LanguageModel(["p", "q"], probs, [0.5, 0.5])
    word = "abaxb" * 3
    assert model.log_likelihoods([word, word[::-1]])[0] == pytest.approx([np.log(brute(word, k)) for k in (0, 1)])
    for limit in (0, 32):  # rescaled or not, the same
        L.LONG_WORD, was = limit, L.LONG_WORD
        try:
            assert model.log_likelihoods([word, word])[1] == pytest.approx([np.log(brute(word, k)) for k in (0, 1)])
            found = L.expected_counts(word, {p: v[0] for p, v in probs.items()}, 3)
            assert sum(len(p) * n for p, n in found.items()) == pytest.approx(len(word), abs=1e-3)
        finally:
            L.LONG_WORD = was
    assert model.log_likelihoods(["ab" * 5000])[0, 1] > model.log_likelihoods(["ab" * 5000])[0, 0] > -1e6
    assert sum(len(p) * n for p, n in L.expected_counts("ab" * 2000, {p: v[0] for p, v in probs.items()}, 3).items()) == pytest.approx(4000, rel=1e-2)
    counts = L.expected_counts("abab", {p: v[0] for p, v in probs.items()}, 3)
    assert sum(len(p) * n for p, n in counts.items()) == pytest.approx(4, abs=1e-3)


def test_language_id(spark):
    rng = random.Random(11)
    words = {"x": ["alpha", "beta", "gamma", "delta"], "y": ["ähnlich", "größe", "über", "straße"]}
    rows = [(i, " ".join(rng.choices(words[lang := "xy"[i % 2]], k=rng.randint(3, 20))), lang, 0.5) for i in range(60)]
    rows += [(100, None, "x", 0.1), (101, "", None, 0.1), (102, "123 ... !!", "y", 0.1), (103, "ÜBER Straße", None, 0.1), (103, "ÜBER Straße", None, 0.1), (104, "gamma" * 5000, "x", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs, model).collect()}
    assert all(got[i][0] == "xy"[i % 2] and got[i][1] > 0.9 for i in range(60))
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "y" and got[104][0] == "x"
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(60)) | {103, 104}
    none = L.fit(docs.limit(0))
    assert {r["lang_pred"] for r in L.identify(docs, none).collect()} == {"und"} and L.identify(docs.limit(0), model).count() == 0


@have_data
def test_unlearned_languages_go(spark):
    rng = random.Random(14)
    junk = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60))
    foreign = [
        "Сегодня утром мы пошли в парк и долго гуляли там вместе с друзьями потому что погода была очень хорошая",
        "Tänään aamulla menimme puistoon ja kävelimme siellä pitkään ystävien kanssa koska sää oli todella hyvä",
        "Dzisiaj rano poszliśmy do parku i długo tam spacerowaliśmy z przyjaciółmi ponieważ pogoda była bardzo ładna",
        "今日は天気がとても良いので公園へ散歩に行きました",
        junk,
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs.where("doc_id % 2 = 0"))
    texts = spark.createDataFrame([(-i, t, "?") for i, t in enumerate([*foreign, "This morning we went to the park and walked there for a long time", None, "12 34"], 1)], docs.schema)
    assert {r["doc_id"] for r in L.keep_identified(texts, model).collect()} == {-6}
    held = docs.where("doc_id % 2 = 1")
    before = {r["doc_id"] for r in L.identify(held, model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert len({r["doc_id"] for r in L.keep_identified(held, model).collect()}) >= 0.97 * len(before)


def test_label_model_finds_accuracies_and_dependencies():
    rng = np.random.default_rng(5)
    n, right, votes_at = 6000, [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.8], [0.7, 1.0, 0.9, 0.8, 0.9, 0.9, 0.8]
    y = (rng.random(n) < 0.3).astype(int)
    votes = np.stack([np.where(rng.random(n) < a, np.where(rng.random(n) < p, y, 1 - y), -1) for p, a in zip(right, votes_at, strict=True)], axis=1)
    twin = np.where(rng.random(n) < 0.9, votes[:, 5], np.where(rng.random(n) < 0.6, y, 1 - y))  # says what voter 5 says, mostly
    votes = np.column_stack([votes, twin])
    model = X.LabelModel(votes)
    assert abs(model.accuracy[:7] - right).max() < 0.05
    assert abs(model.prior - 0.3) < 0.04
    linked = {(j, i) for j, i in enumerate(model.parent) if i >= 0}
    assert linked and linked <= {(7, 5), (5, 7)}  # the only dependency there is
    best = ((model.labels >= 0.5) == y).mean()
    majority = ((votes == 1).sum(axis=1) > (votes == 0).sum(axis=1)) == y
    assert best > majority.mean() and best > 0.9
    without = X.LabelModel(np.where(np.arange(8) == 0, -1, votes))  # nobody has annotated anything
    assert abs(without.accuracy[1:7] - right[1:]).max() < 0.08


def test_label_model_and_scores(spark):
    rng = random.Random(12)
    clean = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = rng.choices(clean, k=rng.randint(5, 40)) + (rng.sample(["grobo", "flarn", "zworp"], 2) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic) if rng.random() > 0.03 else 1 - int(toxic)))
    rows += [(900, None, "s"), (901, "", "s"), (902, "flarn", "s"), (902, "flarn", "s"), (903, "word1 " * 300_000, "s"), (904, "word1 " * 300_000 + "grobo flarn", "s"), (None, "flarn", "s")]
    labels += [(900, 1, None), (None, 1, 1), (5000, 0, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = X.fit(docs, marks.where("doc_id < 400 or doc_id > 700"))
    got = {r["doc_id"]: r["score"] for r in X.score(docs, model).collect()}
    held = [(got[i], i % 5 == 0) for i in range(400, 600)]
    assert np.mean([(s >= 0.5) == t for s, t in held]) > 0.97
    assert got[900] == got[901] < 0.5 < got[902] and all(0 <= s <= 1 for s in got.values())
    assert len(model.voter_parent) == len(model.voter_accuracy) and model.voter_accuracy[0] > 0.9
    flat = X.fit(docs, marks.where("toxic = 0"))
    assert 0 < X.score(docs.limit(1), flat).first()["score"] < 0.5
    assert 0 <= X.score(docs.limit(1), X.fit(docs, marks.limit(0))).first()["score"] <= 1
    assert X.score(docs.limit(0), model).count() == 0


def test_fingerprints(spark):
    text = "First paragraph here.\nSecond one is a bit longer, with ten words in it.\n\nA new section."
    rows = [(4, text, "m"), (3, text.replace("longer", "shorter"), "m"), (2, None, "m"), (1, "", "m"), (0, "ab", "m"), (0, "ab", "m"), (7, "a " + "é" * 3000, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, merkle string")
    out = {r["doc_id"]: r for r in P.edited_fingerprints(docs).collect()}
    assert out[4]["fingerprint"] != out[3]["fingerprint"] and 0.5 < out[4]["near_next"] < 1
    assert out[2]["fingerprint"] == out[1]["fingerprint"] and out[2]["near_edited"] == out[2]["near_next"] == 1.0
    assert out[0]["near_edited"] == 1.0 and out[0]["n_chars"] == 2
    assert sorted(r["near_next"] for r in P.edited_fingerprints(docs).where("doc_id = 0").collect()) == [0.0, 1.0]  # the twin, then the first one
    assert P.edited_fingerprints(docs).count() == len(rows) and P.edited_fingerprints(docs.limit(0)).count() == 0
    trees = P.merkle_trees(docs)
    assert trees.columns == ["doc_id", "text", "merkle", "merkle_"]
    a, b = (trees.where(f"doc_id = {i}").select(F.col("merkle_").alias(n)) for i, n in ((4, "a"), (3, "b")))
    assert a.crossJoin(b).select(P.differing_paragraphs(F.col("a"), F.col("b"))).first()[0] == [1]
    assert a.crossJoin(a.select(F.col("a").alias("b"))).select(P.differing_paragraphs(F.col("a"), F.col("b"))).first()[0] == []
    lines = [" a b", "a b", "a  b", "a b ", "a\nb", "a\n\nb", "a\n\n\nb"]
    roots = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "text string").select(P.root(P.leaves(F.col("text")))).collect()]
    assert len(set(roots)) == len(lines)


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "_ROWS_A_RANGE", 3)
    ids = random.Random(13).sample(range(-500, 500), 100)
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(5)
    got = {r["id"]: r["following"] for r in P.with_next(docs, "doc_id", "text").collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: str(j) for i, j in zip(order, order[1:] + order[:1], strict=True)}
    named = spark.createDataFrame([(f"id {i}", str(i)) for i in ids], "name string, text string").repartition(5)
    got = {r["id"]: r["following"] for r in P.with_next(named, "name", "text").collect()}
    order = sorted((f"id {i}" for i in ids), reverse=True)
    assert got == {i: j.removeprefix("id ") for i, j in zip(order, order[1:] + order[:1], strict=True)}


def test_plan_merges():
    sizes = {f"s{i}": 10 for i in range(10)} | {"big": 1000, "mid": 300}
    groups = plan_merges(sizes, 100, 4)
    assert sorted(x for g in groups for x in g) == sorted(f"s{i}" for i in range(10))
    assert plan_merges({"a": 10, "b": 10}, 100, 4) == [] and plan_merges({}, 100, 4) == []


def test_shard_store(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i}") for i in range(100)], "doc_id long, text string")
    with pytest.raises(ValueError):
        store.read()
    store.append(df.where("doc_id < 50"), 5)
    store.append(df.where("doc_id >= 50"), 5)
    store.append(df.limit(0))
    before = store.manifest()
    assert before["version"] == 3 and len(before["shards"]) >= 20 and sum(s["rows"] for s in before["shards"].values()) == 100
    after = store.compact(target_bytes=1 << 20)
    assert len(after["shards"]) < len(before["shards"]) and sum(s["rows"] for s in after["shards"].values()) == 100
    want = sorted(map(tuple, df.collect()), key=repr)
    for v in (None, 3):
        assert sorted(map(tuple, store.read(v).collect()), key=repr) == want
    with pytest.raises(ConflictError):
        store.commit(before, before["shards"], before["schema"])
    assert store.vacuum() == 0 and store.read(3).count() == 100  # young files stay, for readers and for other writers
    assert store.vacuum(retention_seconds=0) > 0 and sorted(map(tuple, store.read().collect()), key=repr) == want
    assert json.loads(store.manifest()["schema"])["type"] == "struct"


def test_shards_of_other_schemas(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([("fr", 2), ("de", 3)], "lang string, doc_id long"))
    with pytest.raises(ValueError, match="doc_id"):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    store.append(spark.createDataFrame([(4, "long " * 500_000, None)], "doc_id long, text string, lang string"))
    store.compact(fan_in=2)
    got = sorted((r["doc_id"], r["text"] and r["text"][:4], r["lang"]) for r in store.read().collect())
    assert got == [(1, "a", None), (2, None, "fr"), (3, None, "de"), (4, "long", None)]
    assert store.read().columns == ["doc_id", "text", "lang"]


def test_vacuum_beside_an_append(spark, tmp_path):
    store, other = ShardStore(spark, str(tmp_path / "store")), ShardStore(spark, str(tmp_path / "store"))
    df = spark.range(30).selectExpr("id as doc_id")
    store.append(df)
    base, written = other.manifest(), other._write(df, 10)  # another writer, before its commit
    store.compact(fan_in=2)
    store.vacuum(retention_seconds=3600)
    with pytest.raises(ConflictError):  # its version was taken: it begins again from the latest
        other.commit(base | {"version": 0}, written, base["schema"])
    latest = other.manifest()
    other.commit(latest, latest["shards"] | written, latest["schema"])
    assert store.read().count() == 60


def test_manifest_parts(spark, tmp_path, monkeypatch):
    import bramble.llm.sharding as sharding

    monkeypatch.setattr(sharding, "PART_SHARDS", 4)
    store = ShardStore(spark, str(tmp_path / "store"))
    df = spark.range(40).selectExpr("id as doc_id").coalesce(1)
    first = store.append(df, 4)
    second = store.append(df, 40)
    assert len(first["parts"]) == 3 and set(first["parts"]) < set(second["parts"])  # a commit writes what is new
    assert store.read().count() == 80 and store.manifest()["shards"] == second["shards"]


@have_data
def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept[name] = docs.count()
    assert 60 >= kept["language_id"] >= kept["line_dedup"] >= kept["near_duplicates"] >= kept["benchmark_decontamination"] > 40
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == kept["benchmark_decontamination"]
