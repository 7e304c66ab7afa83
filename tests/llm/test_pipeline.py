"""The pipeline's stages on planted documents, against plain Python."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, gone int"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree"


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def shingles(text):
    w = words(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(21)
    sounds = {"en": "the of and ing ed tion er ly ment wh th st".split(), "xx": "zu kra vlo ptä mösk rü gno szi baj uhl".split()}

    def text(lang, n=60):
        return " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 3))) for _ in range(n))

    docs = [[i, text(lang), lang] for i, lang in enumerate(["en", "xx"] * 40)]
    base = docs[4][1].split()
    plants = {
        "foreign": [[200, "жук лес снег мороз вода земля река " * 6, None], [201, "12 34 !! ...", None], [202, None, None], [203, "", "en"]],
        "copies": [[210, docs[6][1], "en"], [211, docs[6][1], "en"]],
        "near": [[220, " ".join(base[:20] + ["changedone", "changedtwo"] + base[22:]), "en"]],
        "lines": [[230, "Own words here " + text("en", 30) + "\n" + docs[8][1], "en"]],
        "bench": [[240, text("en", 40) + " " + PASSAGE + " " + text("en", 40), "en"], [241, PASSAGE, "en"]],
    }
    rows = docs + [r for group in plants.values() for r in group]
    return [(i, t, lang, "s", len(t or ""), "c", 1) for i, t, lang in rows], plants


def test_stages(spark, planted, tmp_path):
    from tokenizers import Tokenizer

    from bramble.llm.tokens import default_vocabulary

    rows, plants = planted
    ids = {name: {r[0] for r in group} for name, group in plants.items()}
    spark.createDataFrame([("b1", PASSAGE)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, FIELDS).repartition(3)
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == FIELDS.replace(",", "").split()[::2]
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    everything = {r[0]: r[1] for r in rows}
    clean = set(range(80)) - {4, 6, 8}

    kept = seen["language_id"]
    assert set(kept) == set(everything) - ids["foreign"] and all(kept[i] == everything[i] for i in kept)

    # Lines: the earliest by id stays; one word may differ in lines of six words or more.
    lines, gone = [], {}
    for i in sorted(kept):
        for p, line in enumerate(kept[i].split("\n")):
            w = line.lower().split()
            if w and any(v == w or min(len(v), len(w)) >= 6 and abs(len(v) - len(w)) <= 1 and any(v[:k] + v[k + (len(v) >= len(w)) :] == w[:k] + w[k + (len(w) >= len(v)) :] for k in range(max(len(v), len(w)))) for v in lines):
                gone.setdefault(i, set()).add(p)
            lines.append(w)
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())) for i, t in kept.items()}
    want = {i: t for i, t in want.items() if i not in gone or t.strip()}
    assert seen["line_dedup"] == want and ids["copies"].isdisjoint(want) and want[230].startswith("Own") and "\n" not in want[230]

    before, after = seen["line_dedup"], seen["near_duplicates"]
    sets = {i: shingles(t) for i, t in before.items()}
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert linked == {(4, 220)} and after == {i: t for i, t in before.items() if i != 220}

    final = seen["benchmark_decontamination"]
    assert 241 not in final and PASSAGE[10:40] not in final[240] and final[240].startswith(after[240][:100]) and final[240].endswith(after[240][-100:])
    assert {i: t for i, t in final.items() if i != 240} == {i: t for i, t in after.items() if i not in (240, 241)} and clean <= set(final)

    library = Tokenizer.from_file(default_vocabulary())
    pieces = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == set(final)
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        own = np.array([*library.encode(final[i], add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(g.ids) == own.tobytes() and g.ids_crc32.tolist() == [zlib.crc32(x) for x in g.ids]


def test_null_ids_and_empty_tables(spark, planted, tmp_path):
    rows, _ = planted
    spark.createDataFrame([("b1", PASSAGE)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None if i % 9 == 0 else i, *rest) for i, *rest in rows], FIELDS)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != "packing":
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    texts = {r["text"] for r in docs.collect()}
    assert docs.where("doc_id is null").count() > 5 and rows[9][1] in texts
    assert out.select("doc_id").distinct().count() > 50


def test_language_model_of_all_rows(spark, monkeypatch):
    """Counts and floors are those of every row that may be learned from, as plain Python finds them."""
    from collections import Counter

    from bramble.llm import language_id as L

    rng = random.Random(22)
    letters = {"aa": "abcdeé", "bb": "stuvwü"}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))), lang) for i, lang in enumerate(["aa", "aa", "bb"] * 500)]
    rows += [(2000, "abc" * 30, "aa"), (2001, None, "aa"), (2002, "12", "bb"), (2003, "xyz", None), (None, "abc", "aa")]
    models = []
    monkeypatch.setattr(pipeline, "keep_identified", lambda docs, model: models.append(model) or docs)
    pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "")
    (model,) = models
    learned = [(t, lang) for i, t, lang in rows if lang and i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    assert min(Counter(lang for _, lang in learned).values()) > L.FIT_DOCS / 2 and len(learned) > 2 * L.FIT_DOCS
    pieces = L.load_pieces(L.default_vocabulary())
    for k, lang in enumerate(model.languages):
        words = Counter(w for t, of in learned if of == lang for w in map(L.word_unit, L.letter_runs(t)))
        probs = dict.fromkeys(pieces, 1.0 / len(pieces))
        for _ in range(L.ROUNDS):
            uses = dict.fromkeys(pieces, L.SMOOTH)
            for word, n in words.items():
                for piece, share in L.expected_counts(word, probs, model.longest).items():
                    if piece in uses:
                        uses[piece] += n * share
            total = sum(uses.values())
            probs = {p: v / total for p, v in uses.items()}
        assert np.allclose(model.table[: len(pieces), k], [probs[p] for p in pieces], rtol=1e-6, atol=1e-9)
        scorer = L.Scorer(model)
        fits = [scorer.fit(row, lang) for row, (_, of) in zip(scorer.totals([t for t, _ in learned]), learned, strict=True) if of == lang and row[-1]]
        assert model.floors[lang] == pytest.approx(np.quantile(fits, L.FLOOR_SHARE) - L.FLOOR_MARGIN, abs=1e-9)
