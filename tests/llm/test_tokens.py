"""Encoding, the content-addressed store and packing, against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from bramble.llm.content_store import crc_combine, cut_points, faults, merkle_root, read_documents, verify_store, write_store
from bramble.llm.packing import best_cuts, pack
from bramble.llm.tokens import _ODD_SPACE, Encoder, default_vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    enc, rng = Encoder(default_vocabulary()), random.Random(2)
    alphabet = "aZéÀß ÿ'’.,!<|>endoftext0129\n\t \x1c\x85 ć漢ΣσİIﬁ½²_#&-​́"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|> a<|startoftext|>b", "don't I'LL", "x" * 5000, None, ""]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids_of(library, t)
    plain = [None if t is None else "".join(c for c in t if c not in _ODD_SPACE) for t in texts]
    for some in (texts, plain, plain[:1], [None, ""], []):
        ids, ends = enc.encode_all(some, 7)
        assert ids.tolist() == [i for t in some for i in [*ids_of(library, t), 7]]
        assert ends.tolist() == np.cumsum([len(ids_of(library, t)) + 1 for t in some]).tolist()


def test_crc_combine():
    rng = random.Random(3)
    parts = [[rng.randbytes(rng.randint(0, 50)) for _ in range(rng.randint(1, 6))] for _ in range(50)]
    flat = [x for p in parts for x in p]
    got = crc_combine(np.array([zlib.crc32(x) for x in flat]), np.array([len(x) for x in flat]), np.array([len(p) for p in parts]))
    assert got.tolist() == [zlib.crc32(b"".join(p)) for p in parts]


def test_chunks_and_roots():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 500, 20_000).astype("<u4")
    table = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    (ends,) = cut_points(ids, np.array([len(ids)]), table)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and (sizes[:-1] >= 64).all() and (sizes <= 1024).all()
    (shifted,) = cut_points(np.concatenate([rng.integers(0, 500, 7).astype("<u4"), ids]), np.array([len(ids) + 7]), table)
    assert len({e - 7 for e in shifted} & set(ends)) > len(ends) * 0.8
    assert merkle_root([]) != merkle_root([b""]) and merkle_root([b"a", b"b"]) != merkle_root([b"b", b"a"])


ROWS = [(5, "the cat sat. " * 300, "a"), (3, None, "b"), (4, "", None), (5, "the cat sat. " * 300, "a"), (1, "A dog! " * 900, "c"), (2, "z" * 3000, "d")]


def test_store_round_trip(spark, library, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").repartition(3)
    write_store(docs, str(tmp_path / "s"))
    got = sorted(verify_store(spark, str(tmp_path / "s")).collect())
    start = 0
    for r, (doc, text, _) in zip(got, sorted(ROWS, key=lambda x: x[0]), strict=True):
        ids = np.array([*ids_of(library, text), 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()), True)
        start += len(ids)
    rebuilt = sorted((r["doc_id"], r["ids"]) for r in read_documents(spark, str(tmp_path / "s")).collect())
    assert rebuilt == sorted((d, [*ids_of(library, t), 1]) for d, t, _ in ROWS)
    chunks = spark.read.parquet(str(tmp_path / "s/content")).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert faults(spark, str(tmp_path / "s")).count() == 0
    write_store(docs.limit(0), str(tmp_path / "e"))
    assert verify_store(spark, str(tmp_path / "e")).count() == 0 and faults(spark, str(tmp_path / "e")).count() == 0


def test_store_reports_losses(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * (100 + i)) for i in range(40)], "doc_id long, text string").repartition(3)
    path = str(tmp_path / "s")
    write_store(docs, path)
    chunk, recipe = f"{path}/content", f"{path}/recipes"
    whole = {chunk: spark.read.parquet(chunk).where("kind = 'chunk'").collect(), recipe: spark.read.parquet(recipe).collect()}
    shapes = {name: spark.read.parquet(name).schema for name in whole}

    def rewrite(name, rows):
        spark.createDataFrame(rows, shapes[name]).coalesce(1).write.mode("overwrite").parquet(name)

    rewrite(chunk, whole[chunk][1:])  # a lost chunk
    lost = [r for r in read_documents(spark, path).collect() if r["ids"] is None]
    assert lost and not any(r["verified"] for r in lost) and [r["part"] for r in faults(spark, path).collect()] == [-1]
    assert {r["doc_id"] for r in verify_store(spark, path).collect() if not r["verified"]} == {r["doc_id"] for r in lost}
    first = whole[chunk][0]
    rewrite(chunk, [first.__class__(**{**first.asDict(), "payload": bytes(reversed(first["payload"]))}), *whole[chunk][1:]])  # a changed one
    assert {r["doc_id"] for r in read_documents(spark, path).collect() if not r["verified"]} == {r["doc_id"] for r in lost}
    rewrite(chunk, whole[chunk])
    part = whole[recipe][0]["part"]
    rewrite(recipe, whole[recipe][1:])  # a lost recipe
    assert [r["part"] for r in faults(spark, path).collect()] == [part]
    assert {r["doc_id"] for r in verify_store(spark, path).collect() if not r["verified"]} == {r["doc_id"] for r in whole[recipe][1:] if r["part"] == part}
    rewrite(recipe, [r for r in whole[recipe] if r["part"] != part])  # a lost part
    assert [(r["part"], r["found_rows"]) for r in faults(spark, path).collect()] == [(part, None)]


def test_best_cuts_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        x = [0]
        for _ in range(rng.randint(1, 9)):
            x.append(x[-1] + rng.randint(1, 8))
        pen = [0.0] + [rng.choice([0.0, 2.0, 5.0]) for _ in x[1:]]
        want = [0.0]
        for j in range(1, len(x)):
            want.append(min(want[i] + 8 - (x[j] - x[i]) + pen[j] for i in range(j) if x[j] - x[i] <= 8))
        assert best_cuts(x, pen, 8)[0] == want


@pytest.mark.parametrize("limit", [64, 4096])
def test_packing(spark, library, limit):
    docs = spark.createDataFrame(ROWS[1:] + [(9, "word " * 30000, "x")], "doc_id long, text string, offset string").coalesce(1)
    out = pack(docs, limit=limit).toPandas()
    padding = total = 0
    for _, g in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        n = int(g.length.sum())
        assert n <= limit
        total += n
        padding += 0 if n & (n - 1) == 0 else limit - n
    assert padding < 0.05 * total
    for key, g in out.groupby("doc_id"):
        ids = np.array([*ids_of(library, dict((r[0], r[1]) for r in ROWS + [(9, "word " * 30000, "")])[key]), 2], "<u4")
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and (g.doc_tokens == len(ids)).all() and g.length.sum() == len(ids)
        for r in g.itertuples():
            part = ids[r.start : r.start + r.length].tobytes()
            assert r.ids == part and r.ids_crc32 == zlib.crc32(part)
    assert pack(docs.limit(0)).count() == 0
